"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A corpus is a folder with ``shard-00000.rec``, ``shard-00001.rec`` ... and ``index`` (Parquet).
A record is::

    u64 length of the payload | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of it

and its payload: u8 whether the id is there, i64 doc_id, u8 bytes of an id (2 or 4), the ids.
All numbers are little-endian.  The checksum is CRC-32, masked (rotated by 15 bits plus a
constant) so that checksums of data that hold checksums stay sound.

1. :func:`write_records` deals the documents to shards by ranges of ``doc_id``, sorts each shard,
   encodes the texts there and writes a shard as one stream, to a name of the attempt that is then
   moved to the shard's name: a lost or doubled task leaves the same file.  The index (shard,
   ordinal, doc_id, offset, size, n_tokens) is written by Spark beside it.
2. :func:`read_records` reads shards from first to last record; :func:`read_shuffled` reads records by the
   index in an order that a seed fixes.  Both verify lengths and checksums and raise on a damaged record.
3. :func:`positions` adds the number of ids before each document: a prefix sum over shards (a
   row each) plus the position within the shard.

No id is shared by shards out of order: rows are dealt by (doc_id, hash of the text, row), so rows of one
id, copies among them, may spread over neighbouring shards.  Files are written and read by pyarrow's file
systems (file, hdfs, s3, gs, abfs) in the shared folder.

Defined cases: null and empty texts are documents with the end id alone; null ids come first and
stay null; repeated ids and rows are kept, ordered by the text's hash; an empty table gives no
shard, an empty index and an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm.common import file_system, pin
from lakeops.llm.tokens import ByteLevelIds

END_ID = 0
#: Bytes of text that make a shard, on average.
SHARD_BYTES = 64 << 20
#: Bytes that a writer gathers before it writes, and a reader reads at once.
BUFFER = 4 << 20
MASK_DELTA = 0xA282EAD8

HEAD = struct.Struct("<QI")
ID = struct.Struct("<?qB")
TAIL = struct.Struct("<I")
INDEX = "shard int, ordinal long, doc_id long, offset long, size long, n_tokens long"
RECORD = "shard int, ordinal long, doc_id long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return ID.pack(doc_id is not None, doc_id or 0, width) + ids


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record that starts at ``at``, and where the next one starts."""
    if len(data) < at + HEAD.size:
        raise ValueError("truncated record head")
    length, check = HEAD.unpack_from(data, at)
    if masked(data[at:at + 8]) != check:
        raise ValueError("a record's length is damaged")
    start, end = at + HEAD.size, at + HEAD.size + length
    if len(data) < end + TAIL.size:
        raise ValueError("truncated record")
    body = data[start:end]
    if masked(body) != TAIL.unpack_from(data, end)[0]:
        raise ValueError("a record is damaged")
    return body, end + TAIL.size


def parse(body: bytes) -> tuple[int | None, bytes]:
    """doc_id and the ids as little-endian unsigned 32-bit numbers."""
    there, doc_id, width = ID.unpack_from(body)
    ids = body[ID.size:]
    if width == 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (doc_id if there else None), ids


def _shard(number: int) -> str:
    return f"shard-{number:05d}.rec"


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the documents (columns ``doc_id``, ``text``) as records under ``path``; returns the index."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    order = ["doc_id", "_hash", "_row"]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
            .repartitionByRange(shards, *order).sortWithinPartitions(*order))

    def write(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        files, folder = file_system(path)
        name = f"{folder}/{_shard(shard)}"
        attempt = f"{folder}/_attempts/{uuid.uuid4().hex}"
        encode, out, held, size, ordinal, offset = None, None, [], 0, 0, 0
        for batch in batches:
            if out is None:
                encode = ByteLevelIds(tokenizer_path, end_id)
                end = end_id.to_bytes(encode.width, "little")
                files.create_dir(f"{folder}/_attempts", recursive=True)
                out = files.open_output_stream(attempt)
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = ([], [], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text) + end
                    record = frame(payload(doc, ids, encode.width))
                    for column, x in zip(made, (shard, ordinal, doc, offset, len(record), len(ids) // encode.width)):
                        column.append(x)
                    held.append(record)
                    size += len(record)
                    offset += len(record)
                    ordinal += 1
                    if size > BUFFER:
                        out.write(b"".join(held))
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[0], pa.int32()), *(pa.array(x, pa.int64()) for x in made[1:])],
                    names=["shard", "ordinal", "doc_id", "offset", "size", "n_tokens"])
        if out is not None:
            out.write(b"".join(held))
            out.close()
            files.move(attempt, name)

    rows.select("doc_id", "text").mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _records(rows) -> pa.RecordBatch:
    shard, ordinal, doc, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(ordinal, pa.int64()), pa.array(doc, pa.int64()), pa.array(ids, pa.binary())],
        names=["shard", "ordinal", "doc_id", "ids"])


def shard_bodies(files, name: str):
    """The payloads of a shard in turn, read in pieces of ``BUFFER`` bytes."""
    with files.open_input_stream(name) as source:
        data, at = b"", 0
        while True:
            while len(data) - at >= HEAD.size:
                length, check = HEAD.unpack_from(data, at)
                if masked(data[at:at + 8]) != check:
                    raise ValueError(f"{name}: a record's length is damaged")
                if len(data) - at < HEAD.size + length + TAIL.size:
                    break
                body, at = unframe(data, at)
                yield body
            more = source.read(BUFFER)
            if not more:
                if at != len(data):
                    raise ValueError(f"{name}: truncated record")
                return
            data, at = data[at:] + more, 0


def scan_shards(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    """``each(shard, (doc_id, ids) of its records in turn)`` gives record batches of ``schema``; a task per shard."""
    shards = read_index(spark, path).groupBy("shard").agg(F.count("*").alias("n"))

    def read(batches):
        files, folder = file_system(path)
        for batch in batches:
            for shard, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from each(shard, n, map(parse, shard_bodies(files, f"{folder}/{_shard(shard)}")))

    return shards.mapInArrow(read, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every shard: shard, ordinal, doc_id and the ids as unsigned 32-bit numbers."""

    def each(shard, n, records):
        held, size, seen = [], 0, 0
        for doc, ids in records:
            held.append((shard, seen, doc, ids))
            size += len(ids)
            seen += 1
            if size > BUFFER:
                yield _records(held)
                held, size = [], 0
        if held:
            yield _records(held)
        if seen != n:
            raise ValueError(f"shard {shard} has {seen} records, the index {n}")

    return scan_shards(spark, path, each, RECORD)


def read_shuffled(spark: SparkSession, path: str, seed: int, tasks: int) -> DataFrame:
    """The records in an order that ``seed`` fixes, fetched by offset; ``tasks`` partitions of about equal size."""
    key = F.xxhash64(F.lit(seed), "shard", "ordinal")
    rows = (read_index(spark, path).withColumn("_key", key).repartitionByRange(tasks, "_key")
            .sortWithinPartitions("_key").select("shard", "ordinal", "offset", "size"))

    def fetch(batches):
        files, folder = file_system(path)
        opened, held, size = {}, [], 0
        for batch in batches:
            for shard, ordinal, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard not in opened:
                    if len(opened) > 64:
                        opened.pop(next(iter(opened))).close()
                    opened[shard] = files.open_input_file(f"{folder}/{_shard(shard)}")
                body, end = unframe(opened[shard].read_at(length, offset))
                if end != length:
                    raise ValueError(f"shard {shard}, record {ordinal}: not the indexed size")
                held.append((shard, ordinal, *parse(body)))
                size += length
                if size > BUFFER:
                    yield _records(held)
                    held, size = [], 0
        if held:
            yield _records(held)

    return rows.mapInArrow(fetch, RECORD)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record, read from the shards."""
    def each(shard, n, records):
        made, before, seen = ([], [], [], [], []), 0, 0
        for doc, ids in records:
            for column, x in zip(made, (shard, doc, before, len(ids) // 4, zlib.crc32(ids))):
                column.append(x)
            before += len(ids) // 4
            seen += 1
        if seen != n:
            raise ValueError(f"shard {shard} has {seen} records, the index {n}")
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[0], pa.int32()), *(pa.array(x, pa.int64()) for x in made[1:])],
            names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = pin(scan_shards(spark, path, each, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long"),
               "records")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"),
                                           "n_tokens", "ids_crc32")
