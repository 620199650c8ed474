"""Base spans against plain patterns; contexts that reveal unseen identifiers; masking."""

import random
import re

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def brute(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "")
            if ok(k, m[0])]


def base(df):
    out = {}
    for r in P.find(df).collect():
        out.setdefault(r["doc_id"], []).append(sorted((s["kind"], s["start"], s["stop"]) for s in r["base"]))
    return {d: sorted(x) for d, x in out.items()}


def test_base_spans(spark, docs):
    random.seed(3)
    signs = ["1", "2", "0", ".", ".", "@", "a", "B", "-", "+", "(", ")", " ", "é", "_", "%", "4111 1111 1111 1111", "10.0.0.1",
             "+1 (415) 555-1234", "a@b.c", "256", "\n", "\U0001d4b3"]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    data += [(10_000 + i, "".join(random.choice(signs) for _ in range(random.randint(0, 60)))) for i in range(2000)]
    want = {d: [brute(t)] for d, t in data}
    # long runs stay linear (the plain patterns do not, so the results are stated)
    data += [(20_000, "9" * 200_000), (20_001, "a" * 200_000), (20_002, "1 2" * 50_000)]
    want |= {d: [[]] for d in (20_000, 20_001, 20_002)}
    assert base(spark.createDataFrame(data, "doc_id long, text string")) == want


def test_contexts_reveal_unseen_identifiers(spark):
    data = [(i, f"text login-id: u{i}x{i * 7919 % 1000}@mail.example.com more") for i in range(30)]
    data += [(100, "blah login-id: zq8812x77, more"), (101, "nothing here but zz9912x77 alone"),
             (102, "again zq8812x77 elsewhere")]
    got = {r["doc_id"]: r["spans"] for r in P.digest(P.find(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    assert got[100] == "email:15:24" and got[101] == "" and got[102] == "email:6:15"


def spans(spark, data):
    return {r["doc_id"]: r["spans"] for r in P.digest(P.find(spark.createDataFrame(data, "doc_id long, text string"))).collect()}


def test_prefixes_of_seeds_reveal_identifiers(spark):
    data = [(i, f"entry{i} mail:u{i}x{i * 7919 % 1000}@mail.example.com tail{i}") for i in range(40)]
    data += [(100, "other mail:zq8812x77 more"), (101, "other fax:zq9912x77 more"), (102, "from=zq8812x77")]
    got = spans(spark, data)
    assert got[100] == "email:11:20" and got[101] == "" and got[102] == "email:5:14"


def test_groups_of_digits_are_one_identifier(spark):
    data = [(i, f"entry{i} phone: +49 171 555 {1000 + i} tail{i}") for i in range(40)]
    data += [(100, "other phone: 0171 555 0199, more"), (101, "other pages: 12 13 14"), (102, "x (phone: 555-0123)."), (103, "phone: 77")]
    got = spans(spark, data)
    assert got[100] == "phone:13:26" and got[101] == "" and got[102] == "phone:10:18" and got[103] == "phone:7:9"


def test_unseen_instances_are_no_misses(spark):
    data = [(i, f"entry{i} contact id u{i}@mail.example.com tail{i}") for i in range(20)]
    data += [(100 + i, f"again{i} contact id q{i}w{i * 31}z tail{i}") for i in range(6)]
    got = spans(spark, data)
    assert all(got[100 + i] == f"email:18:{18 + len(f'q{i}w{i * 31}z')}" for i in range(6))


def test_words_after_reveal_identifiers(spark):
    data = [(i, f"entry{i} note{i} 10.0.{i}.7 is-the-server") for i in range(30)] + [(100, "other thing host-77-a, is-the-server")]
    assert spans(spark, data)[100] == "ip:12:21"


def test_mixed_or_common_contexts_reveal_nothing(spark):
    """A word before seeds of several kinds, and one that stands before much else."""
    data = [(i, f"entry{i} see u{i}@mail.example.com tail{i}") for i in range(20)] + [(50 + i, f"entry{i} see 10.0.{i}.7 tail{i}") for i in range(20)]
    data += [(100 + i, f"entry{i} the x{i}@mail.example.com tail{i}") for i in range(20)] + [(200 + i, f"line{i} the {i}th item{i}") for i in range(30)]
    data += [(300, "other see zq8812x77"), (301, "other the zq8812x78")]
    got = spans(spark, data)
    assert got[300] == got[301] == "" and all(got[200 + i] == "" for i in range(30))


def test_long_runs_of_groups_stay_linear(spark):
    data = [(1, "1 " * 60_000 + "1a"), (2, "(1 " * 60_000), (3, "a1@" * 60_000), (4, "x:=" * 60_000 + "1")]
    assert set(spans(spark, data).values()) == {""}


def test_copies_do_not_make_a_pattern(spark):
    data = [(i, "ask for ann@mail.example.com now") for i in range(50)] + [(100, "ask for order77812 now")]
    got = {r["doc_id"]: r["spans"] for r in P.digest(P.find(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    assert got[100] == ""


def test_odd_rows_and_mask(odd, none):
    want = {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], []).append(brute(r["text"]))
    assert base(odd) == {d: sorted(x) for d, x in want.items()}
    masked = P.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert text[10] == "reach me at <email> or <ip>" and text[1] is None and text[4] == "one"
    assert P.find(none).count() == P.mask(none).count() == 0
