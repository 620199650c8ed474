"""WARC fixity audit by Merkle trees over ordered offset ranges.

1. :func:`warc_records` writes pages as WARC response records, laid out one after the other in
   files of about ``FILE_BYTES``; a record knows its file and offset.
2. :func:`tree` hashes each record; a leaf node covers the records that start in ``RANGE_BYTES`` of a
   file, and each level above covers ``FAN`` nodes of the one below, up to one root per file.  The files' roots
   are the leaves of a tree over their names: a node for each beginning of ``NAME_DIGITS`` hexadecimal digits of the
   SHA-256 of a name, then of a digit less, up to one root for the whole replica.  A node's
   hash is that of its children's (place, hash), or (name, hash), in order.
3. :func:`audit` compares the two replicas' roots, and if they differ descends only into branches that do: at
   each level the children of mismatching nodes alone are read, at the end the records of
   mismatching leaves.

A node has at most ``FAN`` children and a leaf at most ``RANGE_BYTES`` / 1 records, whatever
the size of a file, so a file (or a host) with a third of all records is only more nodes.  The tree is
written once per replica, partitioned by level, so an audit reads little more than the roots while
replicas agree.

Defined cases: pages without an id are dealt to ``NULL_BLOCKS`` blocks by their content; a null payload is hashed apart from an empty one; records alike in
file and offset are hashed together in the order of their hashes; a record, range or file that one
replica lacks is reported as missing there; null file names are a file of their own ('');
further columns are ignored; an empty replica has no root, so all of the other one is missing; two empty ones do not differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import pin

FILE_BYTES = 1 << 30
RANGE_BYTES = 1 << 16
FAN = 16
#: Levels of the tree over file names, below its root: 16 ** NAME_DIGITS leaves at most.
NAME_DIGITS = 4
NULL_BLOCKS = 1 << 12
#: Blocks of ids that are laid out on their own, so that offsets need no order over all records.
BLOCK_IDS = 4096


def warc_records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, length, record_id, content): a WARC response record per page.

    Pages are laid out in the order of page_id within blocks of ids; a block begins a new file
    whenever ``file_bytes`` are full.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")),
                    F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    id_ = F.col("page_id").cast("long")
    block = F.when(id_.isNotNull(), F.floor(id_ / BLOCK_IDS)).otherwise(
        -1 - F.pmod(F.xxhash64(F.col("url").cast("string"), body), F.lit(NULL_BLOCKS)))
    rows = pages.select(F.col("page_id").cast("long").alias("record_id"), block.alias("block"),
                        F.concat(head, body, F.lit("\r\n\r\n")).alias("content"))
    sized = rows.withColumn("length", F.octet_length("content").cast("long"))
    before = Window.partitionBy("block").orderBy("record_id", F.xxhash64("content")).rowsBetween(
        Window.unboundedPreceding, -1)
    at = sized.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)))
    name = F.format_string("pages-%06d-%04d.warc", F.col("block"), F.floor(F.col("at") / file_bytes))
    return at.select(name.alias("file"), (F.col("at") % file_bytes).alias("offset"), "length", "record_id", "content")


def leaves(records: DataFrame) -> DataFrame:
    """(file, place, hash, record_id): the hash of every record; ``place`` is its offset."""
    mark = F.when(F.col("content").isNull(), F.lit("null")).otherwise(F.sha2(F.col("content").cast("binary"), 256))
    return records.select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"),
                          F.col("offset").cast("long").alias("place"), mark.alias("hash"),
                          F.col("record_id").cast("long").alias("record_id"))


def _up(nodes: DataFrame, by: list[str], width: int) -> DataFrame:
    """One node for the children in each ``width`` places."""
    child = F.concat_ws(":", F.col("place").cast("string"), F.col("hash"))
    inside = F.array_sort(F.collect_list(F.struct("place", "hash", child.alias("c"))))
    return nodes.groupBy(*by, F.floor(F.col("place") / width).cast("long").alias("up")).agg(
        F.sha2(F.array_join(F.transform(inside, lambda x: x.getField("c")), ","), 256).alias("hash"),
        F.sum("n").alias("n")).select(*by, F.col("up").alias("place"), "hash", "n")


def levels_for(file_bytes: int = FILE_BYTES) -> int:
    """Levels of nodes from ranges to a single root per file."""
    n, levels = max(1, -(-file_bytes // RANGE_BYTES)), 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _names(files: DataFrame, digits: int) -> DataFrame:
    """One node for the files, or nodes, whose names begin alike."""
    child = F.concat_ws(":", "file", "hash")
    inside = F.array_sort(F.collect_list(F.struct("file", "hash", child.alias("c"))))
    return files.groupBy(F.substr("digest", F.lit(1), F.lit(digits)).alias("digest")).agg(
        F.sha2(F.array_join(F.transform(inside, lambda x: x.getField("c")), ","), 256).alias("hash"), F.sum("n").alias("n")).select(
        F.col("digest").alias("file"), F.lit(0).cast("long").alias("place"), "hash", "n", "digest")


def _with_digest(files: DataFrame) -> DataFrame:
    return files.withColumn("digest", F.sha2("file", 256))


def tree(records: DataFrame, file_bytes: int = FILE_BYTES) -> list[DataFrame]:
    """The written levels of a replica: records, ranges, ... , one root per file, beginnings of names, ... , one root."""
    levels = [pin(leaves(records).withColumn("n", F.lit(1).cast("long")), "fixity")]
    for level in range(levels_for(file_bytes)):
        levels.append(pin(_up(levels[-1].select("file", "place", "hash", "n"), ["file"], RANGE_BYTES if level == 0 else FAN),
                          "fixity"))
    nodes = _with_digest(pin(levels[-1].groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("place", "hash"))), lambda x: F.concat_ws(":", x.getField("place").cast("string"), x.getField("hash"))), ","), 256).alias("hash"),
        F.sum("n").alias("n")), "fixity"))
    for digits in range(NAME_DIGITS, -1, -1):
        levels.append(pin(_names(nodes, digits), "fixity"))
        nodes = levels[-1]
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, place) of nodes that are not the same in both."""
    x, y = a.alias("x"), b.alias("y")
    same = (F.col("x.file") == F.col("y.file")) & (F.col("x.place") == F.col("y.place"))
    return x.join(y, same, "full_outer").filter(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select(
        F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.place", "y.place").alias("place")).distinct()


def _below(nodes: DataFrame, bad: DataFrame, width: int) -> DataFrame:
    """The children of mismatching nodes."""
    up = bad.select(F.col("file").alias("_file"), F.col("place").alias("_up"))
    return nodes.join(up, (F.col("file") == F.col("_file")) & (F.floor(F.col("place") / width) == F.col("_up")), "left_semi")


def _named(nodes: DataFrame, bad: DataFrame, digits: int) -> DataFrame:
    """The nodes whose names begin as those of mismatching nodes."""
    up = bad.select(F.col("file").alias("_up"))
    return nodes.join(up, F.substr(F.col("digest"), F.lit(1), F.lit(digits)) == F.col("_up"), "left_semi")


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """(file, offset, record_id, state): the records that differ, by descent from the roots.

    ``state`` is 'altered', 'missing' (only the first replica has it) or 'extra' (only the second).
    """
    files = len(first) - NAME_DIGITS - 2   # the level of the files' roots
    bad = pin(_differ(first[-1], second[-1]), "fixity_differ")
    if bad.isEmpty():   # the replicas agree: nothing but two roots has been read
        return first[0].limit(0).select("file", F.col("place").alias("offset"), "record_id", F.lit("").alias("state"))
    for digits, level in enumerate(range(len(first) - 2, files, -1)):
        bad = pin(_differ(*[_named(t[level], bad, digits) for t in (first, second)]), "fixity_differ")
    roots = [_named(_with_digest(t[files]), bad, NAME_DIGITS) for t in (first, second)]
    bad = pin(_differ(*[r.select("file", "place", "hash") for r in roots]), "fixity_differ")
    for level in range(files - 1, 0, -1):
        bad = pin(_differ(_below(first[level], bad, FAN), _below(second[level], bad, FAN)), "fixity_differ")
    x, y = _below(first[0], bad, RANGE_BYTES).alias("x"), _below(second[0], bad, RANGE_BYTES).alias("y")
    same = (F.col("x.file") == F.col("y.file")) & (F.col("x.place") == F.col("y.place")) & F.col(
        "x.record_id").eqNullSafe(F.col("y.record_id"))
    state = (F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("altered"))
    return x.join(y, same, "full_outer").filter(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select(
        F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.place", "y.place").alias("offset"),
        F.coalesce("x.record_id", "y.record_id").alias("record_id"), state.alias("state")).distinct()


def damaged(records: DataFrame) -> DataFrame:
    """A second replica with known damage, for trials: by the SHA-256 digest of its id, a record
    has one character overwritten (digest 00...) or is lost (01...)."""
    kind = F.coalesce(F.substring(F.sha2(F.col("record_id").cast("string"), 256), 1, 2), F.lit(""))
    half = F.floor(F.length("content") / 2).cast("int")
    flipped = F.concat(F.substr("content", F.lit(1), half), F.lit("\x00"), F.substr("content", half + 2))
    return records.filter(kind != "01").withColumn(
        "content", F.when(kind == "00", flipped).otherwise(F.col("content")))
