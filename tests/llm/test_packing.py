"""Packing: an exact round trip of token ids, and the windows' layout."""

import random
import zlib

import numpy as np
import pytest

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import packing as P
from lakeops.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def _check(texts, pieces, tokenizer, window=P.WINDOW):
    by_row, used = {}, {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        by_row.setdefault(p["doc_id"], []).append(p)
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) <= window
    for doc, text in texts.items():
        ids = b"".join(p["ids"] for p in sorted(by_row[doc], key=lambda p: p["start"]))
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert all(p["doc_tokens"] == len(want) for p in by_row[doc])
    return used


def test_round_trip_and_layout(spark, docs, tokenizer):
    pieces = [r.asDict() for r in P.pack_documents(docs, tokenizer_path()).collect()]
    used = _check({r["doc_id"]: r["text"] for r in docs.collect()}, pieces, tokenizer)
    lost = sum(0 if sum(n for _, n in s) & (sum(n for _, n in s) - 1) == 0 else P.WINDOW - sum(n for _, n in s)
               for s in used.values())
    assert lost < 0.02 * sum(p["length"] for p in pieces)


def test_words_alone_give_the_ids_of_the_text(tokenizer):
    random.seed(1)
    signs = list("abzÉé×÷ßÄñ.,.,'ś …!?<|>09 \n\x1c\x85ΣςA") + ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "...", ",,"]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, P.token_bytes(texts, tokenizer_path())):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    assert P.best_fit([60, 50, 40, 30, 20], 100) == [(0, 0), (1, 0), (0, 60), (1, 50), (1, 80)]
    random.seed(2)
    lengths = sorted((random.randint(1, 100) for _ in range(500)), reverse=True)
    left = []
    for n, (number, offset) in zip(lengths, P.best_fit(lengths, 100)):
        fits = sorted(x for x in left if x >= n)
        if fits:
            assert left[number] == fits[0] and offset == 100 - fits[0]
            left[number] -= n
        else:
            assert number == len(left) and offset == 0
            left.append(100 - n)


def test_odd_rows(odd, none, tokenizer):
    pieces = [r.asDict() for r in P.pack_documents(odd, tokenizer_path(), cell_docs=4).collect()]
    assert sum(p["start"] == 0 for p in pieces) == odd.count()
    assert {p["doc_tokens"] for p in pieces if p["doc_id"] in (1, 2, 3)} == {1}
    _check({5: odd.filter("doc_id = 5").first()["text"]}, pieces, tokenizer)
    assert P.pack_documents(none, tokenizer_path()).count() == 0
