"""Packing by best-fit decreasing over a segment tree of remaining capacities.

1. :func:`tokenise` turns each document into token ids plus one end id, and cuts it
   into full windows and one shorter tail (overlong documents are cut first).
2. :func:`pack` deals the pieces to cells by a hash of the piece.  The number of cells
   follows the number of documents, so a cell stays a bounded task at any input size,
   and a document of any length is spread over cells piece by piece.
3. In a cell, pieces go longest first into the tightest open window that still fits
   them; a segment tree indexed by remaining capacity finds that window.

Defined cases: null and empty texts are documents with the end id alone; null and
repeated ``doc_id`` and repeated rows are packed like any other rows; an empty table gives
an empty result; further columns are ignored.  Ties are broken by (length, doc_id, start,
crc), so a task that runs again gives the same windows.
"""

from __future__ import annotations

import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.tokens import SpacelessIds

WINDOW = 2048
END_ID = 1
#: Documents a cell holds on average.
CELL_DOCS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_ENCODERS: dict[str, SpacelessIds] = {}


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpacelessIds(path)
    return [_ENCODERS[path](t) for t in texts]


def tokenise(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
             keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``window`` ids per document, ids included unless ``keep_ids`` is off."""
    schema = PIECES if keep_ids else PIECES.rsplit(",", 1)[0]
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[], [], [], [], [], []]
                texts = part.column(1).to_pylist()
                for doc, ids in zip(part.column(0).to_pylist(), token_bytes(texts, tokenizer_path)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start:4 * (start + window)]
                        for out, x in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), total,
                                                 piece)):
                            out.append(x)
                arrays = [pa.array(x, pa.int64()) for x in rows[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays.append(pa.array(rows[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.at = [[] for _ in range(window + 1)]

    def put(self, capacity: int, item) -> None:
        self.at[capacity].append(item)
        node = capacity + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = True
            node >>= 1

    def take(self, need: int):
        """The tightest window with at least ``need`` left: (capacity, window), or None."""
        tree, node = self.tree, need + self.leaves
        if not tree[node]:
            while True:
                if node & 1 == 0 and tree[node + 1]:
                    node += 1
                    break
                node >>= 1
                if node <= 1:
                    return None
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        item = self.at[capacity].pop()
        if not self.at[capacity]:
            tree[node] = False
            node >>= 1
            while node:
                tree[node] = tree[2 * node] or tree[2 * node + 1]
                if tree[node]:
                    break
                node >>= 1
        return capacity, item


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) for each length; the lengths come longest first."""
    open_, out, made = OpenWindows(window), [], 0
    for n in lengths:
        found = open_.take(n) if n < window else None
        if found is None:
            capacity, number = window, made
            made += 1
        else:
            capacity, number = found
        out.append((number, window - capacity))
        if capacity > n:
            open_.put(capacity - n, number)
    return out


def pack(pieces: DataFrame, cells: int, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces; ``cells`` tasks pack on their own."""
    from pyspark.sql.types import LongType, StructField, StructType
    cell = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(cells))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])

    def fill(key, rows):
        rows = rows.drop_columns(["cell"]).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
             ("ids_crc32", "ascending")])
        placed = best_fit(rows["length"].to_pylist(), window)
        base = key[0].as_py() << 32
        return (rows.append_column("sequence_id", pa.array([base + n for n, _ in placed], pa.int64()))
                .append_column("offset", pa.array([o for _, o in placed], pa.int64())))

    return pieces.withColumn("cell", cell).groupBy("cell").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
                   keep_ids: bool = True, cell_docs: int = CELL_DOCS) -> DataFrame:
    """Tokenise and pack whole documents (columns ``doc_id``, ``text``)."""
    cells = max(1, docs.count() // cell_docs)
    return pack(tokenise(docs, tokenizer_path, window, end_id, keep_ids), cells, window)
