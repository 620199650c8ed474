"""Personal data: base patterns, and identifiers found by bootstrapped contexts, on DataFrame functions only.

Base.  Emails, IP addresses, card and phone numbers by one pattern per kind, leftmost and without
overlap; matches that fail the kind's test (parts, digits, checksum) are dropped.
Positions are code points; they come from the lengths of the pieces between matches, added up by a
window per text.

Method.  Words with a digit or ``@`` outside the base spans are candidates; words of digits and signs that
follow each other by single spaces are one.
1. Each base span is a seed: an instance of its kind with score 1.
2. A pattern is what stands around an instance, within ``CONTEXT`` code points of it: the word before it, the two words before it,
   the word after it, or a prefix that ends in ``:`` or ``=`` in the same word (lower case, digits as 0).
   Signs that stick to an instance are no part of it or of its context.
3. Patterns and instances form a graph.  A pattern's score for a kind is the sum of its known instances' scores for that
   kind over that for all kinds: instances of other kinds count against it.  It counts from ``LEAST_SEEDS``
   distinct known instances and ``LEAST_SCORE`` on, and if these are at least ``LEAST_KNOWN`` of all its instances, so that a word that stands
   before anything reveals nothing.  A candidate's score is that of its best pattern.
4. After ``ROUNDS`` rounds every occurrence of a candidate with ``LEAST_SCORE`` is a span of its kind.
Distinct instances count, so copies of a text do not raise a pattern.

A frequent pattern is summed on the map side and then one row; nothing is collected or broadcast.

Defined cases: a null or empty text has no spans; null and repeated doc_ids and repeated rows are
rows of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import fresh, pin

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  A match starts where the last one ended (\G) or not inside a run that
#: has been tried; possessive repeats keep long runs linear.  They match what the plain ones do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Groups of digits with single spaces, or words with a digit or @, and what makes a text worth a search.
_GROUP = r"[+(]?[0-9][0-9().+/-]*+(?![^\x20\x09-\x0D.,;:!?])"
CANDIDATE = rf"(?:\G|(?<=[\x20\x09-\x0D]))(?:{_GROUP}(?:\x20{_GROUP})++|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "": "[0-9@]"}
LEAST_SEEDS = 10
LEAST_SCORE = 0.8
LEAST_KNOWN = 0.5
ROUNDS = 3
CONTEXT = 64


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def add(total, x):
        place, d = x.getField("i"), x.getField("d")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 1, twice).otherwise(d)
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1),
                       lambda i: F.struct(i.alias("i"), F.ascii(F.substr(F.reverse(digits), i + 1, F.lit(1))).alias("c")))
    each = F.transform(each, lambda x: F.struct(x.getField("i").alias("i"), (x.getField("c") - 48).alias("d")))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", F.length(digits).between(8, 15)).otherwise(True))


def matches(docs: DataFrame, key: Column) -> DataFrame:
    """(row, doc_id, kind, start, stop, match, left, right): base matches that pass and candidates (kind '').

    Every row of ``docs`` has at least one row, with null ``match`` if that is all.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def pieces(kind, pattern):
        # the text between matches, then each match, in turn
        between = F.transform(F.split(F.col("text"), pattern, -1),
                              lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("left"),
                                                 F.left(p, F.lit(CONTEXT)).alias("head")))
        found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        # what cannot match is not searched; an email stands for the row itself
        none = F.array(F.struct(F.length("text").alias("n"), F.lit("").alias("left"), F.lit("").alias("head")))
        there = F.col("text").rlike(HINT[kind])
        return F.struct(F.lit(kind).alias("kind"), F.arrays_zip(
            F.when(there, between).otherwise(none).alias("p"),
            F.when(there, found).otherwise(F.array().cast("array<string>")).alias("m")).alias("x"))

    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = F.explode(F.array(*[pieces(k, p) for k, p in PATTERNS.items()], pieces("", CANDIDATE)))
    # the matches become a column of their own first, so that a row of them does not carry all the others
    each = (rows.select("row", "doc_id", kinds.alias("k")).select("row", "doc_id", F.col("k.kind").alias("kind"),
                                                                  F.col("k.x").alias("x"))
            .select("row", "doc_id", "kind", F.posexplode("x"))
            .select("row", "doc_id", "kind", "pos", "col.p.n", "col.p.left", "col.p.head", F.col("col.m").alias("match")))
    size = F.col("n") + F.coalesce(F.length("match"), F.lit(0))
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = each.withColumn("stop", F.sum(size).over(before)).withColumn(
        "right", F.lead("head").over(Window.partitionBy("row", "kind").orderBy("pos")))
    return (stop.filter(F.col("match").isNotNull() | ((F.col("kind") == "email") & (F.col("pos") == 0)))
            .withColumn("match", F.when(_passes(F.col("kind"), F.col("match")), F.col("match")))
            .filter(F.col("match").isNotNull() | ((F.col("kind") == "email") & (F.col("pos") == 0)))
            .select("row", "doc_id", "kind", (F.col("stop") - F.length("match")).alias("start"), "stop", "match", "left", "right"))


def _candidates(found: DataFrame) -> DataFrame:
    """Candidates that touch no base span, without the signs around them."""
    base = F.col("kind") != ""
    order = Window.partitionBy("row").orderBy("start", F.desc(base))
    # both look back (down in reverse order), which adds up in one pass
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)
    rows = found.filter("match is not null").withColumn("_end", F.max(F.when(base, F.col("stop"))).over(up)).withColumn(
        "_next", F.min(F.when(base, F.col("start"))).over(down))
    free = rows.filter((F.col("kind") == "") & (F.coalesce("_end", F.lit(0)) <= F.col("start"))
                       & (F.coalesce("_next", F.col("stop")) >= F.col("stop")))
    # a prefix up to : or = is context, quotes and points around the rest are dropped
    prefix = F.regexp_extract("match", r"^([^:=]*+[:=]++)", 1)
    prefix = F.when(prefix.rlike("[A-Za-z]"), prefix).otherwise(F.lit(""))
    body = F.expr("substr(match, length(_prefix) + 1)")
    out = free.withColumn("_prefix", prefix).withColumn("_body", body).withColumn(
        "_lead", F.length("_body") - F.length(F.regexp_replace("_body", r"^[^A-Za-z0-9+]+", ""))).withColumn(
        "_core", F.regexp_replace(F.regexp_replace("_body", r"^[^A-Za-z0-9+]+", ""), r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", ""))
    start = F.col("start") + F.length("_prefix") + F.col("_lead")
    return out.select("row", "doc_id", start.alias("start"), (start + F.length("_core")).alias("stop"),
                      F.col("_core").alias("match"), "left", F.col("_prefix").alias("prefix"), "right").filter(
        F.col("match").rlike("[0-9@]"))


def _patterns(left: Column, prefix: Column, right: Column) -> Column:
    """The patterns that an instance stands in; ``left`` ends before its word, ``right`` begins after it."""
    # brackets and quotes that open a word are no part of it
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), r"^[(\[{<\"']+", "")
    one = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    after = F.regexp_extract(F.coalesce(right, F.lit("")), r"^[^A-Za-z0-9\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]|$)", 1)
    return F.filter(F.array(F.concat(F.lit("1 "), clean(one)), F.concat(F.lit("2 "), clean(two)), F.concat(F.lit("r "), clean(after)),
                            F.concat(F.lit("p "), clean(prefix))), lambda x: F.length(x) > 2)


def _seeds(found: DataFrame) -> DataFrame:
    """(instance, kind, pattern) of the base spans, whose word is taken apart as that of a candidate."""
    tail = F.regexp_extract("left", r"([^\x20\x09-\x0D]*)$", 1)
    prefix = F.when(F.col("_tail").rlike("^[^:=]*[:=]+$") & F.col("_tail").rlike("[A-Za-z]"), F.col("_tail")).otherwise(F.lit(""))
    # what sticks to a span and is neither signs nor a prefix is no context, nor is what stands before it
    outer = F.when((F.col("_prefix") != "") | ~F.col("_tail").rlike("[A-Za-z0-9]"),
                   F.expr("substr(left, 1, length(left) - length(_tail))")).otherwise(F.lit(""))
    return (found.filter((F.col("kind") != "") & F.col("match").isNotNull()).withColumn("_tail", tail).withColumn("_prefix", prefix)
            .withColumn("_outer", outer).select(F.lower("match").alias("instance"), "kind",
                                                F.explode(_patterns(F.col("_outer"), F.col("_prefix"), F.col("right"))).alias("pattern")))


def bootstrap(found: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of the candidates that high-confidence patterns find."""
    unseen = candidates.select(F.lower("match").alias("instance"), F.lit(None).cast("string").alias("kind"),
                               F.explode(_patterns(F.col("left"), F.col("prefix"), F.col("right"))).alias("pattern"))
    graph = pin(_seeds(found).unionAll(unseen).distinct(), "pii_graph")
    size = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("n")).filter(F.col("n") >= LEAST_SEEDS)
    known = graph.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    edges = graph.select("pattern", "instance").distinct()
    scores = known
    for _ in range(rounds):
        points = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
        # at most a row per kind for each pattern
        points = points.withColumn("all", F.sum("sum").over(Window.partitionBy("pattern"))).withColumn("score", F.col("sum") / F.col("all"))
        good = (points.filter((F.col("support") >= LEAST_SEEDS) & (F.col("score") >= LEAST_SCORE)).join(size, "pattern")
                .filter(F.col("sum") >= LEAST_KNOWN * F.col("n")).select("pattern", "kind", "score"))
        new = (graph.filter("kind is null").select("instance", "pattern").join(good, "pattern").groupBy("instance")
               .agg(F.max(F.struct("score", "kind")).alias("x")).select("instance", "x.kind", "x.score"))
        new = pin(new, "pii_scores")
        scores = known.unionAll(new)
    return new


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(F.array(*[F.lit(k) for k in KINDS]), x.getField("kind")), x.getField("start"), x.getField("stop"))), ",")


def find(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, row, base, spans) per row of ``docs``: arrays of (kind number, start, stop), base ones and all.

    ``key`` stands for ``doc_id`` in the result.
    """
    found = pin(matches(docs, F.col("doc_id").cast("long") if key is None else key), "pii_matches")
    candidates = pin(_candidates(found), "pii_candidates")
    unseen = bootstrap(found, candidates)
    more = candidates.withColumn("instance", F.lower("match")).join(unseen, "instance").select(
        "row", "doc_id", "kind", "start", "stop", F.lit(False).alias("base"))
    base = found.filter(F.col("kind") != "").select("row", "doc_id", F.when(F.col("match").isNotNull(), F.col("kind")).alias(
        "kind"), "start", "stop", F.lit(True).alias("base"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    span = F.when(F.col("kind").isNotNull(), F.struct(number.cast("int").alias("kind"), F.col("start").cast("long").alias(
        "start"), F.col("stop").cast("long").alias("stop")))
    return base.unionAll(more).withColumn("span", span).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("base"), F.col("span"))).alias("base"),
        F.collect_list("span").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the digest of their list, and the list of all spans."""
    count = lambda i: F.size(F.filter("base", lambda x: x.getField("kind") == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; null texts stay null.

    Spans meet their text by id and a hash of the text; rows alike in both have the same spans.
    """
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    spans = (find(docs, key).filter(F.size("spans") > 0).groupBy("doc_id").agg(F.first("spans").alias("spans"))
             .select(F.col("doc_id.id").alias("_id"), F.col("doc_id.mark").alias("_mark"),
                     F.col("spans").alias(fresh(docs, "_spans"))))
    found = F.col(spans.columns[2])
    order = F.array_sort(F.transform(found, lambda x: F.struct(x.getField("start").alias("start"), x.getField(
        "stop").alias("stop"), x.getField("kind").alias("kind"))))

    def cut(state, x):
        at, out = state.getField("at"), state.getField("out")
        fresh = x.getField("start") >= at
        name = F.concat(F.lit("<"), F.get(F.array(*[F.lit(k) for k in KINDS]), x.getField("kind")), F.lit(">"))
        gap = F.substr(F.col("text"), at.cast("int") + 1, (x.getField("start") - at).cast("int"))
        return F.struct(F.greatest(at, x.getField("stop")).alias("at"),
                        F.when(fresh, F.concat(out, F.array(gap, name))).otherwise(out).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(order, start, cut, lambda s: F.concat(F.array_join(s.getField("out"), ""), F.substr(
        F.col("text"), s.getField("at").cast("int") + 1, F.length("text"))))
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(spans, (mark == spans["_mark"]) & docs["doc_id"].cast("long").eqNullSafe(spans["_id"]), "left")
    return joined.withColumn("text", F.when(found.isNull(), F.col("text")).otherwise(done)).select(*docs.columns)
