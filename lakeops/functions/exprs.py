"""Column -> Column expressions.

All of them are built from Spark SQL functions, so they run inside
whole-stage codegen next to the scans and joins that feed them; none is a
Python UDF.  Where the workspace treats bad input as empty, ``try_*`` forms
are used so ANSI mode never fails a job on one malformed row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

ColumnLike = Column | str

# Placeholder text, defaults of a cluster config, naming rules.
DASH = "—"
UNKNOWN_LABEL = "Unknown"
UNTITLED = "Untitled"
DEFAULT_SLUG = "cluster"
SLUG_MAX = 51
SLUG_INVALID = r"[^a-z0-9-]+"
CR_PREFIX = "qs-"
CLONE_SUFFIX = "-clone"
CONFIG_DEFAULTS = {
    "worker_min": 1,
    "worker_max": 2,
    "cpu_request": "500m",
    "cpu_limit": "1",
    "memory_request": "1Gi",
    "memory_limit": "2Gi",
    "idle_minutes": 30,
}
RESOURCE_FIELDS = ("cpu_request", "cpu_limit", "memory_request", "memory_limit")
DYNAMIC_ALLOCATION_KEYS = (
    "spark.dynamicAllocation.enabled",
    "spark.dynamicAllocation.shuffleTracking.enabled",
    "spark.dynamicAllocation.minExecutors",
    "spark.dynamicAllocation.maxExecutors",
)
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def js_trim(x: ColumnLike) -> Column:
    """Strip leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


# --- R6 -------------------------------------------------------------------

def blank_to_null(x: ColumnLike) -> Column:
    """'' -> NULL, as the registry stores optional text."""
    return F.nullif(_c(x), F.lit(""))


def null_to_blank(x: ColumnLike) -> Column:
    """NULL -> '', as optional text is read back."""
    return F.coalesce(_c(x), F.lit(""))


# --- S1-S4: cluster status ---------------------------------------------------

def ready_state(phase: ColumnLike) -> Column:
    """True when a phase reads as ready but not as "not ready" (S1)."""
    n = F.translate(F.lower(F.coalesce(_c(phase), F.lit(""))), " -_", "")
    return n.contains("ready") & ~n.contains("notready")


def phase_badge(phase: ColumnLike, ready: ColumnLike) -> Column:
    """struct(kind, label) of the status badge (S2); ready always wins."""
    p = js_trim(F.coalesce(_c(phase), F.lit("")))
    low = F.lower(p)
    kind = (F.when(F.coalesce(_c(ready), F.lit(False)), "ready")
            .when((low == "") | (low == "unknown"), "unknown")
            .when(low.contains("running"), "running")
            .when(low.contains("fail") | low.contains("error"), "failed")
            .otherwise("pending"))
    label = (F.when(kind == "ready", "Ready")
             .when(kind == "unknown", UNKNOWN_LABEL)
             .otherwise(p))
    return F.struct(kind.alias("kind"), label.alias("label"))


def is_terminal(desired_state: ColumnLike, ready: ColumnLike, phase: ColumnLike) -> Column:
    """Polling may stop: desired Stopped, or ready, or phase exactly Running (S3)."""
    return (F.coalesce(_c(desired_state) == "Stopped", F.lit(False))
            | F.coalesce(_c(ready), F.lit(False))
            | F.coalesce(_c(phase) == "Running", F.lit(False)))


def age_label(ts: ColumnLike, now: ColumnLike) -> Column:
    """Compact age '42s' / '5m' / '3h' / '2d'; missing time -> '—' (S4)."""
    secs = F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", _c(ts), _c(now)))
    mins = F.floor(secs / 60)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    return (F.when(_c(ts).isNull(), DASH)
            .when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h")))
            .otherwise(F.concat(days.cast("string"), F.lit("d"))))


# --- S5, S12-S15, S17: cluster configuration ---------------------------------

def _dash_if_blank(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(DASH))


def resource_summary(res: ColumnLike) -> Column:
    """'cpu_req→cpu_lim · mem_req→mem_lim' with blanks as '—' (S5)."""
    r = _c(res)
    return F.when(r.isNull(), DASH).otherwise(F.concat(
        _dash_if_blank(r["cpu_request"]), F.lit("→"), _dash_if_blank(r["cpu_limit"]),
        F.lit(" · "),
        _dash_if_blank(r["memory_request"]), F.lit("→"), _dash_if_blank(r["memory_limit"])))


def _json_num(v: Column, path: str) -> Column:
    """Numeric coercion of the JSON value at ``path``, NULL when not finite.

    Follows JavaScript ``Number(v)``: missing -> NULL (caller's default),
    null -> 0, booleans -> 1/0, numbers as is, strings trimmed ('' -> 0).
    """
    x = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(x)
    text = js_trim(F.try_variant_get(x, "$", "string"))
    out = (F.when(x.isNull(), None)
           .when(kind == "VOID", F.lit(0.0))
           .when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0))
           .when(kind == "STRING", F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double")))
           .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), None)
           .otherwise(F.try_variant_get(x, "$", "double")))
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), None).otherwise(out)


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def clean_map(m: ColumnLike) -> Column:
    """Trim keys, drop blank keys, and let the last duplicate key win.

    Works under the default map-key dedup policy (which rejects duplicates):
    an entry is kept only when no later entry has the same trimmed key.
    """
    e = F.filter(F.transform(F.map_entries(_c(m)),
                             lambda x: F.struct(js_trim(x["key"]).alias("key"),
                                                F.coalesce(x["value"], F.lit("")).alias("value"))),
                 lambda x: x["key"] != "")
    keys = F.transform(e, lambda x: x["key"])
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e), F.lit(1))),
                                              lambda y: y["key"] == x["key"]))
    # The quadratic last-wins pass runs only for maps that do have duplicates.
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), e).otherwise(last))


_STR_MAP = T.MapType(T.StringType(), T.StringType())


def _resource(v: Column, which: str) -> Column:
    fields = []
    for f in RESOURCE_FIELDS:
        raw = F.try_variant_get(v, f"$.{which}.{f}", "string")
        fields.append(js_trim(F.coalesce(raw, F.lit(CONFIG_DEFAULTS[f]))).alias(f))
    return F.struct(*fields)


_MAPS_SCHEMA = T.StructType([T.StructField(k, _STR_MAP) for k in ("spark_conf", "env", "tags")])


def _config_parts(maps: Column, v: Column) -> dict[str, Column]:
    """Independent pieces of a normalised config from the parsed JSON.

    ``v`` is the config as a variant (typed lookups); ``maps`` is the same text
    read with ``from_json`` into the three string maps, which keeps the
    document's key order so "last duplicate wins" after trimming follows the
    text (a variant object sorts its keys).
    """

    def smap(key: str) -> Column:
        m = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")).startswith("OBJECT"),
                   maps[key])
        return clean_map(F.coalesce(m, F.create_map().cast(_STR_MAP)))

    name_v = F.try_variant_get(v, "$.name", "variant")
    return {
        "name": F.when(F.schema_of_variant(name_v) == "STRING",
                       js_trim(F.try_variant_get(v, "$.name", "string"))).otherwise(F.lit("")),
        "_wmin": _json_num(v, "$.worker_min"),
        "_wmax": _json_num(v, "$.worker_max"),
        "_idle": _json_num(v, "$.idle_minutes"),
        "driver": _resource(v, "driver"),
        "executor": _resource(v, "executor"),
        "image": js_trim(F.coalesce(F.try_variant_get(v, "$.image", "string"), F.lit(""))),
        "spark_conf": smap("spark_conf"),
        "env": smap("env"),
        "tags": smap("tags"),
    }


def _clamp_counts(wmin_raw: Column, wmax_raw: Column, idle_raw: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0).cast("long")
    wmin = F.greatest(zero, _trunc(F.coalesce(wmin_raw, F.lit(float(CONFIG_DEFAULTS["worker_min"])))))
    wmax_default = F.greatest(wmin, F.lit(CONFIG_DEFAULTS["worker_max"]).cast("long")).cast("double")
    wmax = F.greatest(wmin, _trunc(F.coalesce(wmax_raw, wmax_default)))
    idle = F.greatest(zero, _trunc(F.coalesce(idle_raw, F.lit(float(CONFIG_DEFAULTS["idle_minutes"])))))
    return wmin, wmax, idle


def _config_struct(p: dict[str, Column], wmin: Column, wmax: Column, idle: Column) -> Column:
    return F.struct(
        p["name"].alias("name"), wmin.alias("worker_min"), wmax.alias("worker_max"),
        p["driver"].alias("driver"), p["executor"].alias("executor"), p["image"].alias("image"),
        idle.alias("idle_minutes"), p["spark_conf"].alias("spark_conf"), p["env"].alias("env"),
        p["tags"].alias("tags"))


def config_normalize(config_json: ColumnLike) -> Column:
    """Partial cluster config JSON -> complete typed config struct.

    name trimmed (non-string -> ''); worker_min = max(0, trunc(min or 1));
    worker_max = max(worker_min, trunc(max or max(worker_min, 2)));
    resources filled with defaults and trimmed; idle = max(0, trunc(idle or 30));
    maps get trimmed non-blank keys.  As one expression it repeats the parse
    in every branch; over a table prefer :func:`normalize_configs`.
    """
    c = _c(config_json)
    p = _config_parts(F.from_json(c, _MAPS_SCHEMA), F.try_parse_json(c))
    return _config_struct(p, *_clamp_counts(p["_wmin"], p["_wmax"], p["_idle"]))


def normalize_configs(df: DataFrame, config_col: str = "config", out: str = "cfg") -> DataFrame:
    """``df`` plus ``out``: :func:`config_normalize` of ``config_col``, staged.

    The JSON is parsed once per row into a column and each piece is computed
    once in its own projection, so the generated code stays small (one flat
    expression would repeat the parse in every conditional branch and outgrow
    whole-stage codegen).
    """
    parsed = df.withColumns({"_cfg_v": F.try_parse_json(F.col(config_col)),
                             "_cfg_m": F.from_json(F.col(config_col), _MAPS_SCHEMA)})
    p = _config_parts(F.col("_cfg_m"), F.col("_cfg_v"))
    staged = parsed.withColumns({f"_cfg_{k}": v for k, v in p.items()})
    wmin, _, idle = _clamp_counts(F.col("_cfg__wmin"), F.col("_cfg__wmax"), F.col("_cfg__idle"))
    staged = staged.withColumns({"_cfg_wmin": wmin, "_cfg_idle": idle})
    wmin_c = F.col("_cfg_wmin")
    # worker_max depends on the clamped worker_min: one more projection.
    _, wmax, _ = _clamp_counts(wmin_c, F.col("_cfg__wmax"), F.col("_cfg__idle"))
    staged = staged.withColumn("_cfg_wmax", F.greatest(wmin_c, wmax))
    cols = {k: F.col(f"_cfg_{k}") for k in p}
    result = staged.withColumn(out, _config_struct(cols, wmin_c, F.col("_cfg_wmax"), F.col("_cfg_idle")))
    return result.drop(*[c for c in result.columns if c.startswith("_cfg_")])


def conf_merge(base_conf: ColumnLike, user_conf: ColumnLike, worker_min: ColumnLike,
               worker_max: ColumnLike, default_executors: ColumnLike) -> Column:
    """Spark conf of a cluster.

    Base (catalog) conf, then user conf wins.  Executors = worker_min when > 0,
    else the default.  When worker_max exceeds that, four dynamic-allocation
    keys are added only where the merged conf does not set them already.
    """
    base = F.coalesce(_c(base_conf), F.create_map().cast(_STR_MAP))
    user = F.coalesce(_c(user_conf), F.create_map().cast(_STR_MAP))
    base_only = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(user), k))
    merged = F.map_concat(base_only, user)
    wmin, wmax = _c(worker_min), _c(worker_max)
    inst = F.when(wmin > 0, wmin).otherwise(_c(default_executors)).cast("long")
    derived = F.create_map(
        F.lit(DYNAMIC_ALLOCATION_KEYS[0]), F.lit("true"),
        F.lit(DYNAMIC_ALLOCATION_KEYS[1]), F.lit("true"),
        F.lit(DYNAMIC_ALLOCATION_KEYS[2]), inst.cast("string"),
        F.lit(DYNAMIC_ALLOCATION_KEYS[3]), wmax.cast("string"))
    absent = F.map_filter(derived, lambda k, v: ~F.array_contains(F.map_keys(merged), k))
    autoscale = (wmax > 0) & (wmax > inst)
    return F.when(autoscale, F.map_concat(merged, absent)).otherwise(merged)


def executor_instances(worker_min: ColumnLike, default_executors: ColumnLike) -> Column:
    """Executor count: worker_min when positive, else the default."""
    return F.when(_c(worker_min) > 0, _c(worker_min)).otherwise(_c(default_executors))


def prefix_keys(m: ColumnLike, prefix: str) -> Column:
    """Prefix every key, e.g. tags -> annotations."""
    return F.transform_keys(_c(m), lambda k, v: F.concat(F.lit(prefix), k))


def prune_blank(m: ColumnLike) -> Column:
    """Drop entries with blank values; an empty result is NULL."""
    kept = F.map_filter(_c(m), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def resource_requirements(res: ColumnLike) -> Column:
    """Container resources -> struct(requests map, limits map), blanks pruned."""
    r = _c(res)
    requests = prune_blank(F.create_map(F.lit("cpu"), r["cpu_request"], F.lit("memory"), r["memory_request"]))
    limits = prune_blank(F.create_map(F.lit("cpu"), r["cpu_limit"], F.lit("memory"), r["memory_limit"]))
    return F.when(requests.isNull() & limits.isNull(), None).otherwise(
        F.struct(requests.alias("requests"), limits.alias("limits")))


def idle_minutes_of(config_json: ColumnLike) -> Column:
    """idle_minutes from a JSON config; missing or malformed -> 0.

    Like a strict JSON decode into an integer field: only an integral JSON
    number counts; strings, fractions and bad JSON give 0.
    """
    x = F.try_variant_get(F.try_parse_json(_c(config_json)), "$.idle_minutes", "variant")
    integral = F.schema_of_variant(x).isin("TINYINT", "SMALLINT", "INT", "BIGINT")
    return F.coalesce(F.when(integral, F.try_variant_get(x, "$", "long")), F.lit(0).cast("long"))


# --- S6, S7: names -------------------------------------------------------------

def slug(name: ColumnLike) -> Column:
    """DNS-safe name fragment."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(name), F.lit(""))), SLUG_INVALID, "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    s = F.when(s == "", F.lit(DEFAULT_SLUG)).otherwise(s)
    cut = F.regexp_replace(F.substring(s, 1, SLUG_MAX), r"-+$", "")
    return F.when(F.length(s) > SLUG_MAX, cut).otherwise(s)


def cr_name(name: ColumnLike, key: ColumnLike) -> Column:
    """'qs-<slug>-<8 hex>' with a deterministic suffix from ``key``."""
    suffix = F.substring(F.sha2(_c(key).cast("string"), 256), 1, 8)
    return F.concat(F.lit(CR_PREFIX), slug(name), F.lit("-"), suffix)


def path_segments(path: ColumnLike) -> Column:
    """Non-empty '/'-separated parts of a path."""
    return F.filter(F.split(F.coalesce(_c(path), F.lit("")), "/"), lambda s: s != "")


def display_name(name: ColumnLike, path: ColumnLike) -> Column:
    """Trimmed name, else last path segment, else 'Untitled' (S7)."""
    n = js_trim(F.coalesce(_c(name), F.lit("")))
    tail = F.try_element_at(path_segments(path), F.lit(-1))
    return (F.when(n != "", n)
            .when(F.coalesce(js_trim(tail), F.lit("")) != "", tail)
            .otherwise(F.lit(UNTITLED)))


# --- S8, S9, S10, S11: time and cell text ---------------------------------------

def ts_text(ts: ColumnLike) -> Column:
    """'yyyy-MM-dd HH:mm:ss', fraction dropped."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def parse_time_or_null(text: ColumnLike) -> Column:
    """RFC 3339 text -> timestamp, anything else -> NULL."""
    t = js_trim(_c(text))
    return F.when(t.rlike(RFC3339), F.try_to_timestamp(t))


def quote_ident(name: str) -> str:
    """Quote an identifier for SQL text, doubling embedded backticks."""
    return "`" + name.replace("`", "``") + "`"


def quote_ident_col(name: ColumnLike) -> Column:
    """Column form of :func:`quote_ident`."""
    return F.concat(F.lit("`"), F.replace(_c(name), F.lit("`"), F.lit("``")), F.lit("`"))


def cell_text(col: ColumnLike, data_type: T.DataType) -> Column:
    """Display text of one sample cell: NULL -> 'NULL', nested -> JSON."""
    c = _c(col)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        txt = F.to_json(c, {"ignoreNullFields": "false"})
    else:
        txt = c.cast("string")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(txt)


def cell_text_frame(df: DataFrame) -> DataFrame:
    """Every column of ``df`` rendered with :func:`cell_text`."""
    return df.select([cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# --- O3 --------------------------------------------------------------------------

def sorted_entries(m: ColumnLike) -> Column:
    """Map -> key-sorted entries, so equal maps render identically (O3)."""
    return F.array_sort(F.map_entries(_c(m)))


def entries_text(m: ColumnLike, sep: str = ",") -> Column:
    """Key-sorted 'k=v' text of a map (stable across engines)."""
    return F.array_join(F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), sep)
