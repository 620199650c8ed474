"""Quality rules: robust multivariate outliers per language and source, on DataFrame functions only.

Every text gives a vector of transformed statistics:
  ln(1 + words), mean word length, ln(1 + symbols per 100 characters), and the square roots of the
  shares of repeated lines and of words in repeated three-word windows.
Per (lang, source) the minimum covariance determinant (MCD) estimate is found by C-steps: keep the ``SHARE`` of the vectors with
least distance, take their mean and covariance, and go on with the distances under those.  They run from ``STARTS`` deterministic
starts: medians with median deviations, the plain mean and covariance, and those of the ``FEW`` vectors with the least hashes.
After ``FIRST_STEPS`` steps each group goes on from the start whose covariance has the least determinant, until the
determinant of no group falls any more (``MOST_STEPS`` at most); the least one met counts.  Then one reweighting step: mean and
covariance of all vectors within the ``INSIDE`` quantile of chi-squared with 5 degrees.  Each covariance of
a kept part is made consistent with the normal distribution by its factor (:func:`consistency`).  Equal vectors count once, so
copies of a text have no more weight than the text.  A text is rejected if its squared Mahalanobis distance is above
``CUT``, the 0.9999 quantile of chi-squared with 5 degrees; no label takes part.

Small groups lean on wider ones.  The same C-steps run over all rows, over each lang and over each
(lang, source), and each estimate of n vectors is mixed with the next wider one, as if that one stood for
``LEAST`` more vectors: a group of 10 is judged almost as its language is, one of 10,000 by itself.  The estimate of
all rows is mixed with their plain mean and covariance, so a table of a few rows rejects hardly anything.

All group work is sums and counts: a C-step adds 20 sums per group, and order statistics come from
counts of fine bins (``BINS`` to a power of two), so a source with a third of all rows
is only more rows before the map-side aggregation.  Each variance has a floor (``FLOOR``), since a statistic that
is zero for most texts has no spread of its own.

Defined cases: a null or empty text has no words and fails the base rule; null lang and null source are
groups of their own; every row that passes the base rule has a distance, however small its group or the
table; null and repeated doc_ids are judged row by row; :func:`judge` ignores
further columns and :func:`keep` returns them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import SPACES, pin, words

SYMBOLS = "#*$%&|<>"
SHARE = 0.5
STARTS, FIRST_STEPS, MOST_STEPS = 3, 2, 20
FEW = 24
#: A determinant's logarithm that falls by less does not fall any more: the width of the order statistics' bins.
LEAST_FALL = 1e-3
#: The weight of the wider estimate, in vectors.
LEAST = 100
BINS = 64
#: Quantiles of chi-squared with 5 degrees of freedom: of ``SHARE``, of the reweighting step (0.975) and of the cut (0.9999).
CHI2_SHARE = 4.3515
INSIDE, CHI2_INSIDE = 0.975, 12.8325
CUT = 25.7448
#: Smallest variance of each statistic.
FLOOR = (0.15, 0.10, 0.05, 0.01, 0.01)
STATS = ("x0", "x1", "x2", "x3", "x4")
GROUP = ("lang", "source")
#: The groups at each level: all rows, the rows of a lang, the rows of a (lang, source).
LEVEL = "_level"
KEYS = (LEVEL, *GROUP)


def consistency(share: float, quantile: float) -> float:
    """What a covariance of the ``share`` of normal vectors within a chi-squared ``quantile`` is to be multiplied by.

    The share over the distribution function of chi-squared with 7 (two more) degrees of freedom.
    """
    inner = 1 + quantile / 3 + quantile * quantile / 15
    return share / (math.erf(math.sqrt(quantile / 2)) - math.sqrt(2 * quantile / math.pi) * math.exp(-quantile / 2) * inner)


def _not_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(ws: Column) -> Column:
    """Words in three-word windows that a list of words holds twice or more.

    Hashes of the windows with their places, sorted, so that equal windows are neighbours; then the
    places of those, sorted, each of which covers three words or those up to the next.
    """
    def at(i):
        return F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))

    def places(p):
        def alike(x, k):
            same = F.get(p, k + 1).getField("h") == x.getField("h")
            return F.coalesce(same, F.lit(False)) | F.when(k > 0, F.get(p, k - 1).getField("h") == x.getField("h")
                                                           ).otherwise(F.lit(False))
        return F.array_sort(F.transform(F.filter(p, alike), lambda x: x.getField("i")))

    def covered(t):
        wide = F.transform(t, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(t, k + 1) - i, F.lit(3))))
        return F.aggregate(wide, F.lit(0), lambda a, x: a + x)

    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), at))
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(_let(_let(windows, places), covered))


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, mark, and the counts of the base rule) per row; ``mark`` is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    found = F.struct(
        _let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        (F.length(text) - _not_in(text, SPACES)).alias("c"), _not_in(text, SYMBOLS).alias("s"),
        F.xxhash64(text).alias("m"))
    one = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
                      found.alias("f"))
    out = one.select("doc_id", "lang", "source", F.col("f.m").alias("mark"), F.col("f.w.n").cast("long").alias("n_words"),
                     F.col("f.c").cast("long").alias("word_chars"), F.col("f.s").cast("long").alias("n_symbols"),
                     F.col("f.l.n").cast("long").alias("n_lines"),
                     (F.col("f.l.n") - F.col("f.l.d")).cast("long").alias("n_dup_lines"),
                     F.col("f.w.r").cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistics(counted: DataFrame) -> DataFrame:
    """Adds the transformed statistics x0 ... x4."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = (F.log1p("n_words"), F.col("word_chars") / n,
         F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
         F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
         F.sqrt(F.col("n_repeat_words") / n))
    return reduce(lambda d, p: d.withColumn(p[0], p[1]), zip(STATS, x), counted)


def _quantile(values: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """The ``share`` quantile of a value that is not negative, per group, from counts of bins.

    Bins are ``BINS`` to a power of two; the upper edge of the bin is taken.
    """
    bin_ = F.ceil(F.log2(F.col(value) + 1e-6) * BINS)
    w = Window.partitionBy(*by)
    per = values.groupBy(*by, bin_.alias("_bin")).agg(F.count("*").alias("_n"))
    up = per.withColumn("_up", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    at = up.filter(F.col("_up") >= share * F.col("_all")).groupBy(*by).agg(F.min("_bin").alias("_bin"))
    return at.select(*by, F.pow(F.lit(2.0), F.col("_bin") / BINS).alias(out))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in by])


def _join(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins group values to rows; null keys are groups too."""
    named = groups.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in groups.columns if c not in by])
    return rows.join(named, _same(rows, named, by), how).drop(*[f"_{k}" for k in by])


def _model() -> list[str]:
    """The columns of an estimate: means m0 ... and covariances s00, s01, ..."""
    p = len(STATS)
    return [f"m{i}" for i in range(p)] + [f"s{i}{j}" for i in range(p) for j in range(i, p)]


def _moments(rows: DataFrame, by: list[str], factor: float = 1.0) -> DataFrame:
    """Per group: means m0 ... and covariances s00, s01, ..., times the factor and with the floors."""
    p = len(STATS)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)]
    sums += [(factor * F.covar_pop(STATS[i], STATS[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i, p)]
    out = rows.groupBy(*by).agg(*sums)
    for i in range(p):
        out = out.withColumn(f"s{i}{i}", F.col(f"s{i}{i}") + FLOOR[i])
    return out


def _factor(moments: DataFrame, drop: bool = True) -> DataFrame:
    """Adds the Cholesky factor l10, l20, l21, ... of each covariance and r0 ..., one over its diagonal; drops the covariance unless told not to.

    Without nulls or divisions, so that the generated code stays small.
    """
    p = len(STATS)
    moments = moments.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in _model() if c.startswith("s")})
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            moments = (moments.withColumn(f"r{i}", F.pow(F.greatest(rest, F.lit(1e-9)), F.lit(-0.5))) if i == j
                       else moments.withColumn(f"l{i}{j}", rest * F.col(f"r{j}")))
    return moments.drop(*[f"s{i}{j}" for i in range(p) for j in range(i, p)]) if drop else moments


def _determined(moments: DataFrame) -> DataFrame:
    """Adds ``log_det``, the logarithm of each covariance's determinant."""
    log_det = reduce(lambda a, b: a + b, [F.lit(-2.0) * F.log(f"r{i}") for i in range(len(STATS))])
    return _factor(moments, drop=False).withColumn("log_det", log_det).select(*moments.columns, "log_det")


def _distance(rows: DataFrame, out: str) -> DataFrame:
    """Adds the squared distance by forward substitution through the factor."""
    p = len(STATS)
    for i in range(p):
        y = F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", y * F.col(f"r{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(p)])
    return rows.withColumn(out, total).drop(*[f"_y{i}" for i in range(p)])


def _levels(vectors: DataFrame) -> DataFrame:
    """The distinct vectors of each level's groups: (_level, lang, source) is (0, null, null), (1, lang, null), (2, lang, source)."""
    none = F.lit(None).cast("string")
    keys = F.array(*[F.struct(F.lit(i).alias(LEVEL), *[(F.col(k) if j < i else none).alias(k) for j, k in enumerate(GROUP)])
                     for i in range(len(GROUP) + 1)])
    return vectors.select(F.explode(keys).alias("_k"), *STATS).select("_k.*", *STATS).distinct()


def _medians(rows: DataFrame, by: list[str], values: list[Column], out: str) -> DataFrame:
    """Per group: the medians of the values, as ``out`` with a number."""
    each = rows.select(*by, F.posexplode(F.array(*values)).alias("_i", "_v"))
    at = _quantile(each, [*by, "_i"], "_v", 0.5, "_q")
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{out}{i}") for i in range(len(values))])


def _mixed(own: DataFrame, wider: DataFrame, by: list[str]) -> DataFrame:
    """The estimates ``own``, each mixed with the one of ``wider`` for its keys ``by``."""
    names = _model()
    wider = wider.select(*by, *[F.col(c).alias(f"_{c}") for c in names])
    both = _join(own, wider, by) if by else own.crossJoin(wider)
    share = F.col("n") / (F.col("n") + LEAST)
    return both.select(*GROUP, *[(share * F.col(c) + (1 - share) * F.col(f"_{c}")).alias(c) for c in names])


def _starts(vectors: DataFrame, by: list[str]) -> DataFrame:
    """The vectors with their squared distance ``_d2`` under each start ``_start``."""
    center = pin(_medians(vectors, by, [F.col(x) for x in STATS], "m"), "mcd_center")
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATS)]
    spread = pin(_join(center, _medians(_join(vectors, center, by), by, [F.abs(v) for v in off], "d"), by), "mcd_spread")
    z = [v / F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i]) for i, v in enumerate(off)]
    medians = _join(vectors, spread, by).withColumn("_d2", reduce(lambda a, b: a + b, [v * v for v in z]))
    some = vectors.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*STATS), *STATS))).filter(F.col("_at") <= FEW)
    plain, few = (_distance(_join(vectors, _factor(pin(_moments(x, by), "mcd_start")), by), "_d2") for x in (vectors, some))
    cols = [*by, *STATS, "_d2"]
    return reduce(DataFrame.unionByName, [d.select(*cols).withColumn("_start", F.lit(i)) for i, d in enumerate((medians, plain, few))])


def _step(rows: DataFrame, by: list[str]) -> DataFrame:
    """A C-step: the moments, with ``log_det``, of the ``SHARE`` of each group's rows with least ``_d2``."""
    edge = pin(_quantile(rows, by, "_d2", SHARE, "_edge"), "mcd_edge")
    kept = _join(rows.select(*by, *STATS, "_d2"), edge, by).filter(F.col("_d2") <= F.col("_edge"))
    return pin(_determined(_moments(kept, by, consistency(SHARE, CHI2_SHARE))), "mcd_model")


def least_determinant(vectors: DataFrame, by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The MCD model of each group, with ``log_det``, and the models of all steps (the first ones by ``_start`` too)."""
    each, steps = [*by, "_start"], []
    dealt = vectors.withColumn("_start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    rows = _starts(vectors, by)
    for _ in range(FIRST_STEPS):
        steps.append(_step(rows, each))
        rows = _distance(_join(dealt, _factor(steps[-1].drop("log_det")), each), "_d2")
    names = [*_model(), "log_det"]
    best = pin(steps[-1].groupBy(*by).agg(F.min_by(F.struct(*names), F.struct("log_det", "_start")).alias("x")).select(*by, "x.*"), "mcd_best")
    for _ in range(MOST_STEPS):
        rows = _distance(_join(vectors, _factor(best.drop("log_det")), by), "_d2")
        model = _step(rows, by)
        steps.append(model)
        both = _join(model, best.select(*by, *[F.col(c).alias(f"_{c}") for c in names]), by)
        fall = both.agg(F.max(F.col("_log_det") - F.col("log_det"))).first()[0]
        better = F.col("log_det") < F.col("_log_det")
        best = pin(both.select(*by, *[F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names]), "mcd_best")
        if fall is None or fall < LEAST_FALL:
            break
    return best, steps


def estimates(vectors: DataFrame) -> DataFrame:
    """Per (lang, source): mean and Cholesky factor of the reweighted MCD estimate, mixed with the wider ones."""
    by = list(KEYS)
    vectors = pin(_levels(vectors), "mcd_vectors")
    best, _ = least_determinant(vectors, by)
    rows = _distance(_join(vectors, _factor(best.drop("log_det")), by), "_d2")
    # reweighting: all vectors within the quantile, not only the share
    model = _moments(rows.filter(F.col("_d2") <= CHI2_INSIDE), by, consistency(INSIDE, CHI2_INSIDE))
    sizes = vectors.groupBy(*by).agg(F.count("*").alias("n"))
    model = pin(_join(model, sizes, by), "mcd_model")
    wider = pin(_moments(vectors.filter(F.col(LEVEL) == 0), by), "mcd_plain")
    for i in range(len(GROUP) + 1):
        wider = _mixed(model.filter(F.col(LEVEL) == i), wider, list(GROUP[:max(0, i - 1)]))
    return pin(_factor(wider), "mcd_mixed")


def judge(docs: DataFrame) -> DataFrame:
    """A verdict per row of ``docs``: doc_id, lang, source, mark (a hash of the text), the counts,
    ``base_failed``, ``distance`` (squared; null for a row that failed the base rule in a group of such rows only) and ``kept``."""
    by = list(GROUP)
    rows = pin(statistics(counts(docs)), "mcd_counts")
    judged = _distance(_join(rows, estimates(rows.filter(~F.col("base_failed"))), by, "left"), "distance")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUT)).select(
        "doc_id", "lang", "source", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; rows alike in id, language, source and text share a verdict."""
    good = judge(docs).filter("kept").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "lang", "source", "mark")])
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(good, (mark == good["_mark"]) & docs["doc_id"].cast("long").eqNullSafe(good["_doc_id"])
                     & docs["lang"].eqNullSafe(good["_lang"]) & docs["source"].eqNullSafe(good["_source"]), "left_semi")
