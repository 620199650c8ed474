"""Record files of token ids: exact round trips, damage, shuffled reads."""

import random
import struct
import zlib

import numpy as np
import pytest

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import records as R
from lakeops.llm.queries import tokenizer_path
from lakeops.llm.tokens import ByteLevelIds
from lakeops.session import shared_dir

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [R.END_ID]


def test_words_alone_give_the_ids_of_the_text(tokenizer):
    random.seed(3)
    encode = ByteLevelIds(PATH, R.END_ID)
    signs = list("abzÉé×÷ßÄñ.,.,'s  …!?<|>09 \n\t\x1c\x85　 ΣA日́") + ["<|endoftext|>", "it's", "...", ",,", " word.", "\n\n", "  "]
    for _ in range(4000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(encode(text), f"<u{encode.width}").tolist() == _ids(tokenizer, text)[:-1], repr(text)


def test_memory_of_words_is_bounded(tokenizer):
    encode = ByteLevelIds(PATH, R.END_ID)
    encode.ids.most = 50
    for i in range(2000):
        text = f"Common word{i}. and w{i % 7}, end"
        assert np.frombuffer(encode(text), "<u2").tolist() == _ids(tokenizer, text)[:-1]
    assert len(encode.ids) + len(encode.ids.old) < 150


def test_query_positions(spark, docs, tokenizer):
    path = shared_dir(spark, "test-records")
    index = R.write_records(docs, path, PATH, shard_bytes=100_000)
    assert index.select("shard").distinct().count() > 3
    got = {r["doc_id"]: r for r in R.positions(spark, path).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = _ids(tokenizer, r["text"])
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"]) == (start, len(ids))
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not got


def test_sequential_and_shuffled_reads_hold_the_same_records(spark, docs, tokenizer):
    path = shared_dir(spark, "test-records")
    R.write_records(docs, path, PATH, shard_bytes=100_000)
    plain = [tuple(r) for r in R.read_records(spark, path).collect()]
    order = [tuple(r) for r in R.read_shuffled(spark, path, 7, 3).collect()]
    assert sorted(plain) == sorted(order) and plain != order
    assert order == [tuple(r) for r in R.read_shuffled(spark, path, 7, 3).collect()]
    assert [r[:2] for r in order] != [r[:2] for r in map(tuple, R.read_shuffled(spark, path, 8, 3).collect())]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for _, _, doc, ids in plain:
        assert np.frombuffer(ids, "<u4").tolist() == _ids(tokenizer, texts[doc])
    by_shard = sorted(plain)
    assert [r[2] for r in by_shard] == sorted(texts)


def test_the_file_format_by_hand(spark, tokenizer):
    path = shared_dir(spark, "test-records")
    R.write_records(spark.createDataFrame([(5, "ab cd"), (None, "x")], "doc_id long, text string"), path, PATH)
    with open(path.removeprefix("file://") + "/shard-00000.rec", "rb") as f:
        data = f.read()

    def checksum(b):
        crc = zlib.crc32(b)
        return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) % (1 << 32)

    want = b""
    for there, doc, text in ((0, 0, "x"), (1, 5, "ab cd")):
        ids = _ids(tokenizer, text)
        body = struct.pack("<BqB", there, doc, 2) + struct.pack(f"<{len(ids)}H", *ids)
        length = struct.pack("<Q", len(body))
        want += length + struct.pack("<I", checksum(length)) + body + struct.pack("<I", checksum(body))
    assert data == want


def test_damage_is_found(spark, docs):
    path = shared_dir(spark, "test-records")
    R.write_records(docs.limit(20), path, PATH)
    name = path.removeprefix("file://") + "/shard-00000.rec"
    with open(name, "rb") as f:
        good = f.read()
    for at in (3, 9, 30, len(good) - 2):
        with open(name, "wb") as f:
            f.write(good[:at] + bytes([good[at] ^ 1]) + good[at + 1:])
        with pytest.raises(Exception, match="damaged|truncated"):
            R.read_records(spark, path).collect()
    for cut in (1, 100):
        with open(name, "wb") as f:
            f.write(good[:-cut])
        with pytest.raises(Exception, match="truncated"):
            R.positions(spark, path).collect()


def test_large_ids_take_four_bytes():
    body = R.payload(None, struct.pack("<3I", 1, 70_000, 2), 4)
    assert R.parse(R.unframe(R.frame(body))[0]) == (None, struct.pack("<3I", 1, 70_000, 2))


def test_odd_rows(spark, odd, none, tokenizer):
    path = shared_dir(spark, "test-records")
    R.write_records(odd, path, PATH, shard_bytes=20_000)
    got = [tuple(r) for r in R.positions(spark, path).orderBy("start").collect()]
    rows = odd.collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(_ids(tokenizer, r["text"]))) for r in rows) == \
        [(d is not None, d or 0, n) for d, _, n, _ in sorted(got, key=lambda g: (g[0] is not None, g[0] or 0, g[2]))]
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    path = shared_dir(spark, "test-records")
    R.write_records(none, path, PATH)
    assert R.positions(spark, path).count() == 0 and R.read_records(spark, path).count() == 0
