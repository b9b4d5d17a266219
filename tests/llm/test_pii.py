"""Base spans against the rules as Python runs them, and what the method adds."""

import hashlib
import re

from joulewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return out


TEXTS = [
    None,
    "",
    "no data here, 1 2 3",
    "mail a.b+c@x-y.example.com, then d@e, x@y.z.@q.r a@b.c_d@e.f",
    "é😀 +1 (826) 555-4081 190.137.223.204 du",
    "7536784127813050 4845168114407329",
    "4539578763621486 and 4539 5787 6362 1486 and 4539578763621487 or 1234 5678 9012 3456 7890 1",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0000004 99999999999999999999.1.1.1",
    "+12345678 +1234567 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 (30) 901820",
    "9" * 40000,
    "a" * 40000 + "@",
    "write to joe [at] mail [dot] example.com or 2001:0db8:0000:0000:0000:ff00:0042:8329",
    "1 2-3 4-5 6-7 8-9 0-1 2-3 4-5 6  7",
    "call 555-010-9999; order no. 555-010-9998",
    "\x00+1 555 123 4567\n+1 555 123 4567",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars int")


def test_base_spans(spark):
    got = {r.doc_id: r for r in pii.find_pii(rows(spark, TEXTS + TEXTS)).collect()}
    for i, t in enumerate(TEXTS + TEXTS):
        want = brute(t)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t or "")[:60]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_testdata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_added_spans(spark):
    filler = [f"reach me: u{i}@mail.example.com or +1 (555) 010-{1000 + i}, from {i % 200}.1.2.3" for i in range(50)]
    texts = ["x +1 (826) 555-4081 190.137.223.204 du", "a 7536784127813050 4539578763621486 b", "version 12345678901234567890", "plain words only"]
    got = pii.find_pii(rows(spark, texts + filler)).orderBy("doc_id").collect()
    assert "phone:2:19" in got[0].spans
    assert "card:19:35" in got[1].spans and got[1].n_card == 0
    assert [got[2].spans, got[3].spans] == ["", ""]


def test_phone_candidates_without_hyphen(spark):
    texts = ["call 555.010.9999", "call (555) 010.9999 now", "call 555-010-9999", "call 555 010 9999", "1.2345 only"]
    got = pii.candidates(rows(spark, texts)).orderBy("doc_id").collect()
    want = [[(m.start(), m.end()) for m in re.finditer(pii.LOOSE["phone"], t)] for t in texts]
    assert [[(s.start, s.end) for s in r.spans if not s.base] for r in got] == want == [[(5, 17)], [(5, 19)], [(5, 17)], [], []]


def test_empty_null_and_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a@b.cd")], "doc_id long, text string")
    assert sorted(r.n_email for r in pii.find_pii(nulls).collect()) == [0, 1]
    plan = pii.candidates(nulls)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows(spark):
    """Rows alike in id and text, null ids too, each have a result, and all the same."""
    some = [(5, "a@b.cd and 1.2.3.4"), (None, "a@b.cd"), (None, "a@b.cd"), (5, "a@b.cd and 1.2.3.4"), (5, "other")]
    got = pii.find_pii(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip) for r in got) == [("5", 0, 0), ("5", 1, 1), ("5", 1, 1), ("None", 1, 0), ("None", 1, 0)]
    assert len({(r.doc_id, r.base_sha256, r.spans) for r in got}) == 3
