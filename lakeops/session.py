"""Session construction (T10) and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Fixed defaults a lakeops job expects; callers may override any of them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(catalog_conf: dict[str, str] | None = None, master: str | None = None,
                  app_name: str = "lakeops", remote: str | None = None) -> SparkSession:
    """Build (or reuse) a session with lakeops defaults plus catalog settings.

    ``catalog_conf`` carries ``spark.sql.catalog.<name>.*`` style keys, as a
    lakehouse catalog needs them; they win over the defaults.  ``remote``
    switches to a Spark Connect endpoint instead of a local JVM.
    """
    builder = SparkSession.builder.appName(app_name)
    if remote:
        builder = builder.remote(remote)
    elif master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(catalog_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark application.

    Functions that run in workers refer to it by name, and a job may be started from a folder
    where the workers cannot import it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lakeops_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lakeops-package-")) / "lakeops.zip"   # the driver's: Spark hands it out
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._lakeops_shipped = True


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh directory under the folder that ``spark.checkpoint.dir`` names.

    The executors and the driver of a cluster must share that folder, so it is read
    from the session.  Only a session on one machine (``local[...]``, as in tests) may
    leave it unset; a scratch folder is then made and registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if not base and sc is not None:
        base = sc.getCheckpointDir()
        if not base and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="lakeops-")
            sc.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/".join([base.rstrip("/"), "lakeops", *parts, uuid.uuid4().hex])
