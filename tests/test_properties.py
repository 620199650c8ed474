"""Property checks: Spark expressions against plain-Python statements of the rules,
over generated batches (one Spark job per batch)."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st

from lakeops.functions import exprs as X
from lakeops.operators import activity as V

NAME = st.text(alphabet=st.sampled_from(list("ab-1 _Z.é")), max_size=70)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def py_slug(name: str) -> str:
    s = re.sub(r"[^a-z0-9-]+", "-", name.lower()).strip("-") or "cluster"
    return s[:51].rstrip("-") if len(s) > 51 else s


@SETTINGS
@given(st.lists(NAME, min_size=1, max_size=40))
def test_slug_matches_rule(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    got = {r.i: r.s for r in df.select("i", X.slug("n").alias("s")).collect()}
    assert got == {i: py_slug(n) for i, n in enumerate(names)}


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list("qs-12x")), min_size=1, max_size=9), min_size=1, max_size=30),
       st.lists(st.text(alphabet=st.sampled_from(list("qs-12x")), min_size=1, max_size=6), min_size=1, max_size=8,
                unique=True))
def test_event_attribution_matches_prefix_rule(spark, objects, crs):
    ev = spark.createDataFrame([(i, o, "Normal", "r", "m", None, None) for i, o in enumerate(objects)],
                               "event_id long, object string, type string, reason string, message string, "
                               "cnt long, last_seen timestamp_ntz")
    cl = spark.createDataFrame(list(enumerate(crs)), "id long, cr_name string")
    got = sorted((r.cluster_id, r.event_id) for r in V.cluster_events(ev, cl).collect())
    want = sorted((c, i) for i, o in enumerate(objects) for c, cr in enumerate(crs)
                  if o == cr or o.startswith(cr + "-"))
    assert got == want
