"""Benchmark decontamination: size-partitioned MinHash containment search, on DataFrame functions only.

A short test item inside a long document has a tiny Jaccard similarity with it, and MinHash
finds nothing.  So both sides are partitioned by size: items fall into classes by their number of
shingles, and for a class documents are cut into parts of a size that suits it (``CLASSES``).  For
a hash function, the item's least shingle is also the least of the part it falls into, unless
another of the part's shingles is less.  An item of n shingles held to the share c thus agrees with
some part of p shingles in at least c n / (n + p - 1) of the ``HASHES`` values; the worst case of the
classes, 8 shingles of which 0.8 are held, is missed with probability 0.002, 11 or more shingles
with 0.0002 and less, items held whole with less again.

1. Every shingle of every document updates the minima of its part (one row per part and class).
2. Each minimum is looked up among the items' minima of the class: (document, item) candidates.
3. A candidate is verified exactly: the distinct shingles of the item that the whole document
   holds, at least ``THRESHOLD`` of the item's.

A part has at most 32 shingles, so no group of rows grows with the data; a passage that many
documents share is one candidate per document and item.  The items' minima are few
(``HASHES`` per item) and are broadcast while there are at most ``BROADCAST_ITEMS`` items; beyond,
Spark joins by shuffle.

Defined cases: words are runs without white space, unchanged; an item or text of one to four words is
one shingle; null and empty texts hold and contain nothing; null ids are ids like any other; repeated
(doc_id, text) rows give the pair once, rows of one doc_id count as one document, items of one
item_id as one item; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import pin, words

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 36
#: Shingles of an item from which on a class begins, and the shingles of its parts.
CLASSES = ((8, 32), (4, 8), (1, 2))
BROADCAST_ITEMS = 20_000


def shingles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, h): the hash of the shingle at each place of each text."""
    ws = rows.select(*keys, words(F.col("text").cast("string")).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - SHINGLE, F.lit(0))
    at = ws.select(*keys, "ws", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    # words past the end of a short text are null, which the hash skips
    return at.select(*keys, "at", F.xxhash64(*[F.get("ws", F.col("at") + j) for j in range(SHINGLE)]).alias("h"))


def _value(h: Column, k: int) -> Column:
    """The k-th hash function of a shingle: 32 bits that order shingles anew."""
    return F.hash(h, F.lit(k))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, h, n, part): the distinct shingles of each item, their number, and the part size of its class."""
    one = shingles(benchmark.select(F.col("item_id").cast("long"), "text"), ["item_id"]).select("item_id", "h").distinct()
    n = one.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("n"))
    part = F.coalesce(*[F.when(F.col("n") >= least, size) for least, size in CLASSES])
    return one.join(n, one["item_id"].eqNullSafe(n["_item"])).select("item_id", "h", "n", part.alias("part"))


def signatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, v): the minimum v of hash function k over the shingles h of each group."""
    least = rows.groupBy(*by).agg(*[F.min(_value(F.col("h"), k)).alias(f"v{k}") for k in range(HASHES)])
    return least.select(*by, F.posexplode(F.array(*[f"v{k}" for k in range(HASHES)])).alias("k", "v"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def candidates(docs: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """(doc_id, item_id) pairs whose minima agree for some part and hash function."""
    # three classes at most; without items any class will do
    parts = [r["part"] for r in items.select("part").distinct().collect()] or [CLASSES[0][1]]
    classes = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.floor(F.col("at") / p).cast("int").alias("nr"))
                                  for p in sorted(parts)]))
    cut = shingles(docs, ["doc_id"]).select("doc_id", "h", classes.alias("c")).select("doc_id", "h", "c.part", "c.nr")
    wanted = signatures(items.select("item_id", "part", "h"), ["item_id", "part"])
    return (signatures(cut, ["doc_id", "part", "nr"]).join(_small(wanted, few), ["part", "k", "v"])
            .select("doc_id", "item_id").distinct())


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
              key: Column | None = None) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every pair with at least ``threshold``.

    ``key`` stands for ``doc_id`` in the result.
    """
    texts = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    items = pin(items_of(benchmark), "containment_items")
    few = items.select("item_id").distinct().limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    pairs = pin(candidates(texts, items, few), "containment_candidates")
    # exact check, of the candidates only
    found = (shingles(texts, ["doc_id"]).join(_small(items, few), "h")
             .select("doc_id", "item_id", "n", "h").alias("f")
             .join(pairs.alias("p"), F.col("f.doc_id").eqNullSafe(F.col("p.doc_id"))
                   & F.col("f.item_id").eqNullSafe(F.col("p.item_id")), "left_semi"))
    share = F.col("n_found") / F.col("n")
    return (found.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("h").alias("n_found"))
            .filter(share >= threshold)
            .select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", share.alias("containment")))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item; rows with one doc_id and different texts are judged apart."""
    def key(d):
        return F.struct(d["doc_id"].cast("long").alias("id"), F.xxhash64(d["text"].cast("string")).alias("mark"))
    bad = contained(docs, benchmark, threshold, key(docs)).select(
        F.col("doc_id.id").alias("_id"), F.col("doc_id.mark").alias("_mark")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"])
                     & (F.xxhash64(docs["text"].cast("string")) == bad["_mark"]), "left_anti")
