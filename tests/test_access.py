"""Access rules: every combination of a small directory against the ladder rules."""

from pyspark.sql import functions as F

from lakeops.fixtures import LADDERS
from lakeops.operators import access as A

# One user grant and one group grant on separate objects of either kind.
GRANTS = [
    ("cluster", "batch", "group", "night", "attach"),
    ("notebook", "report", "user", "uma", "edit"),
    ("notebook", "draft", "group", "night", "view"),
]
PRINCIPALS = [("uma", False, []), ("noor", False, ["night", "day"]), ("root", True, []), ("lee", False, ["day"])]
LEVELS = {"notebook": ("view", "run", "edit", "manage"), "cluster": ("attach", "manage")}


def _cases():
    """Every principal asks every level of every object; what the ladder rules say."""
    groups = {u: g for u, _, g in PRINCIPALS}
    for kind, obj in (("notebook", "report"), ("notebook", "draft"), ("cluster", "batch"), ("cluster", "spare")):
        ladder = LEVELS[kind]
        for user, admin, _ in [*PRINCIPALS, ("stranger", False, [])]:
            for owner in ("", user):
                held = [ladder.index(lv) for k, o, t, p, lv in GRANTS if (k, o) == (kind, obj)
                        and (p == user if t == "user" else p in groups.get(user, []))]
                top = len(ladder) - 1 if admin or owner == user else max(held, default=-1)
                for level in (*ladder, "nonsense"):
                    yield kind, obj, level, owner, user, level in ladder and ladder.index(level) <= top


MATRIX = list(_cases())


def _frames(spark):
    grants = spark.createDataFrame(GRANTS, "object_type string, object_id string, principal_type string, "
                                           "principal_id string, level string")
    principals = spark.createDataFrame(PRINCIPALS, "username string, admin boolean, groups array<string>")
    return grants, principals, LADDERS


def test_allows_matrix(spark):
    grants, principals, lad = _frames(spark)
    req = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(MATRIX)],
                                "request_id long, object_type string, object_id string, required string, "
                                "owner string, username string")
    got = {r.request_id: r.allowed for r in A.authorize(req, principals, grants, lad).collect()}
    for i, case in enumerate(MATRIX):
        assert got[i] == case[5], case


def test_effective_levels(spark):
    grants, principals, lad = _frames(spark)
    asked = [("uma", "notebook", "report", "", "edit"), ("noor", "notebook", "draft", "", "view"),
             ("noor", "cluster", "batch", "", "attach"), ("lee", "notebook", "report", "", None),
             ("root", "cluster", "spare", "", "manage"), ("lee", "cluster", "spare", "lee", "manage")]
    pairs = spark.createDataFrame([a[:4] for a in asked], "username string, object_type string, object_id string, owner string")
    got = {(r.username, r.object_id): r.level for r in A.effective_level(pairs, principals, grants, lad).collect()}
    assert got == {(u, o): level for u, _, o, _, level in asked}


def test_view_keeps_rows_without_an_owner(spark):
    grants, principals, lad = _frames(spark)
    rows = [("uma", "notebook", "report", None), ("lee", "notebook", "report", None)]
    objects = spark.createDataFrame(rows, "username string, object_type string, object_id string, owner string")
    assert [r.username for r in A.authorized_view(objects, principals, grants, lad).collect()] == ["uma"]


def test_blank_owner_never_matches(spark):
    grants, principals, lad = _frames(spark)
    req = spark.createDataFrame([(1, "notebook", "nbX", "view", "", "")],
                                "request_id long, object_type string, object_id string, required string, "
                                "owner string, username string")
    assert A.authorize(req, principals, grants, lad).first().allowed is False


def test_validate_grants_reasons(spark):
    rows = [("notebook", "n", "user", "a", "edit"), ("notebook", "n", "robot", "a", "edit"),
            ("notebook", "n", "user", "", "edit"), ("cluster", "c", "group", "g", "edit")]
    g = spark.createDataFrame(rows, "object_type string, object_id string, principal_type string, "
                                    "principal_id string, level string")
    reasons = [r.reason for r in A.validate_grants(g).orderBy("principal_type", "level").collect()]
    assert sorted(map(str, reasons)) == sorted(["None", "bad_principal_type", "missing_principal_id", "bad_level"])


def test_latest_grant_wins_and_keeps_first_created(spark):
    from lakeops.operators.registry import upsert_latest
    log = spark.createDataFrame(
        [(1, "2024-01-01", "notebook", "n", "user", "a", "view"), (2, "2024-01-02", "notebook", "n", "user", "a", "edit")],
        "grant_seq long, created_at string, object_type string, object_id string, principal_type string, "
        "principal_id string, level string")
    cur = upsert_latest(None, log, A.GRANT_KEY, "grant_seq").collect()
    assert len(cur) == 1 and cur[0].level == "edit" and cur[0].created_at == "2024-01-01"
    twice = upsert_latest(upsert_latest(None, log, A.GRANT_KEY, "grant_seq"), log, A.GRANT_KEY, "grant_seq").collect()
    assert [tuple(r) for r in twice] == [tuple(r) for r in cur]


def test_access_matrix_rollup(spark):
    d = spark.createDataFrame([("notebook", "view", True), ("notebook", "view", False), ("cluster", "attach", True)],
                              "object_type string, required string, allowed boolean")
    rows = {(r.object_type, r.required): (r.allowed, r.total) for r in A.access_matrix(d).collect()}
    assert rows[(None, None)] == (2, 3)
    assert rows[("notebook", None)] == (1, 2)


def test_read_attribution_and_membership(spark):
    log = spark.createDataFrame([("alice",), ("",), ("  ",), (None,), ("alice",)], "username string")
    got = {r.reader: r.reads for r in A.read_attribution(log, "svc").collect()}
    assert got == {"alice": 2, "svc": 2, "  ": 1}
    p = spark.createDataFrame([("bob", False, ["data", "data", "ops"]), ("eve", False, [])],
                              "username string, admin boolean, groups array<string>")
    keys = sorted(tuple(r) for r in A.membership(p).collect())
    assert keys == [("bob", "group", "data"), ("bob", "group", "ops"), ("bob", "user", "bob"), ("eve", "user", "eve")]


def test_access_report_views_share_one_evaluation(spark):
    from lakeops.session import shared_dir
    grants, principals, lad = _frames(spark)
    req = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(MATRIX)],
                                "request_id long, object_type string, object_id string, required string, "
                                "owner string, username string")
    rep = A.access_report(req, principals, grants, shared_dir(spark, "test_access_report"), lad)
    want_allowed = sum(1 for c in MATRIX if c[5])
    assert {r.allowed: r.requests for r in rep["summary"].collect()} == {True: want_allowed,
                                                                         False: len(MATRIX) - want_allowed}
    total = [r for r in rep["matrix"].collect() if r.object_type is None][0]
    assert (total.allowed, total.total) == (want_allowed, len(MATRIX))
    assert "FileScan parquet" in rep["matrix"]._jdf.queryExecution().executedPlan().toString()
