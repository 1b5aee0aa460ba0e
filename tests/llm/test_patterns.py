import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, secrets
from quarry.llm import spans as spans_module


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits))) % 10 == 0


def only(s):
    return re.sub("[^0-9]", "", s)


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m[0])) <= 15)]
SECRET = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
HARD = ["a@b.c_d@e.f", "x.y@z.w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.04", "0255.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (2) 345 678 90 +1(", "+12345678", "++123456789012", "passwordsecret=abcdef TOKEN: 'x1234567' api_key=ab", "AKIA" + "A" * 30 + " AKIA12", "f" * 24 + "g" + "0" * 23, "a@b." + "c." * 3000 + "d", "+" * 50 + "1" * 400, "1 " * 500, "😀a@b.co\x01c@d.ef\x02", "tokentoken = = x", "secret:secret:abcdefgh"]


def expected(kinds, text, by_start):
    found = [(k, m.start(), m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{n}:{a}:{b}" for _, a, b, n in sorted(found, key=lambda s: (s[1], s[0]) if by_start else s))


@pytest.mark.parametrize(("module", "kinds", "by_start"), [(pii, PII, False), (secrets, SECRET, True)])
def test_base_spans(spark, odd, plain, module, kinds, by_start):
    hard = spark.createDataFrame([(1000 + i, t, None, "h") for i, t in enumerate(HARD)], "doc_id long, text string, lang string, source string")
    frame = odd.select("doc_id", "text", "lang", "source").union(hard)
    rows = module.digest(module.find(frame)).collect()
    texts = [(i, t) for i, t, _ in plain] + [(1000 + i, t) for i, t in enumerate(HARD)]
    want = Counter((i, hashlib.sha256(expected(kinds, t, by_start).encode()).hexdigest()) for i, t in texts)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in rows) == want
    by_id = dict(texts)
    for r in rows:
        base = expected(kinds, by_id[r["doc_id"]], by_start).split(",") if r["doc_id"] is not None else []
        assert set(filter(None, base)) <= set(r["spans"].split(","))
        if not any(base):
            assert r["spans"] == "" or module is secrets


def test_disclosing_terms(spark):
    """A term that occurs near one entity and nowhere else discloses it; a common one doesn't."""
    rows = [(i, f"ordinary reader Quillfeather wrote from mail{i % 3}@site.org yesterday") if i < 3 else (i, "ordinary reader wrote yesterday about things") for i in range(60)]
    rows = [(i, t.replace(f"mail{i % 3}@", "bob@")) for i, t in rows]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    at = rows[0][1].index("Quillfeather")
    assert f"term:{at}:{at + 12}" in found[0].split(",")
    assert not any(f"term:{rows[0][1].index(w)}:" in found[0] for w in ("ordinary", "reader"))
    assert all(found[i] == "" for i in range(3, 60))


def test_sanitised_texts(odd, empty):
    out = pii.sanitised(odd)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert "<EMAIL>" in rows[14]["text"] and "<PHONE>" in rows[14]["text"] and "a.b@c.de" not in rows[14]["text"]
    assert rows[14]["n_chars"] == len(rows[14]["text"])
    assert rows[5]["text"] == {r["doc_id"]: r["text"] for r in odd.collect()}[5]
    assert out.count() == odd.count()
    assert pii.sanitised(empty).count() == 0
    assert pii.digest(pii.find(empty)).count() == 0


def test_ownership(spark):
    """A value of many owners is an example; one owner's value is found again without its name."""
    live, copied = "Zx9Lq0Rt7Yw2Bn4KcVd8", "Example0Example0Example0"
    rows = [(i, f"token={copied}", f"s{i}") for i in range(4)] + [(10, f"password: {live}", "s1"), (11, f"see {live} here", "s1"), (12, f"see {copied} here", "s2")]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[11]["spans"] == "reuse:4:24"
    assert got[12]["spans"] == ""
    assert (got[10]["n_live"], got[0]["n_copied"]) == (1, 1)
    assert secrets.digest(secrets.find(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0


def test_pieces_join_to_the_text(spark):
    parts = spans_module.pieces(F.lit("a1b22"), "[0-9]+", F.lit(True))
    assert spark.range(1).select(parts.alias("p")).first()["p"] == ["a", "1", "b", "22", ""]


def test_many_matches_in_one_text(spark):
    """Pages of 20,000 addresses and numbers, copied, and of 20,000 assignments: as fast as the text is long."""
    many = " ".join(f"u{i}@site{i % 7}.org é +1 555 {100000 + i}" for i in range(20_000))
    rows = [(0, many), (1, many), (2, "nothing here"), (3, None), *[(i, "ordinary words") for i in range(4, 40)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in pii.digest(pii.find(frame)).collect()}
    for i in (0, 1):
        assert found[i]["base_sha256"] == hashlib.sha256(expected(PII, many, False).encode()).hexdigest()
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert out[0] == out[1] and "@" not in out[0] and out[0].count("<EMAIL>") == out[0].count("<PHONE>") == 20_000
    secret = " ".join(f"token=abc{i:06d}" for i in range(20_000))
    got = secrets.digest(secrets.find(spark.createDataFrame([(0, secret, "s")], "doc_id long, text string, source string"))).first()
    assert got["base_sha256"] == hashlib.sha256(expected(SECRET, secret, True).encode()).hexdigest()
    # 4,000 matches took minutes when pieces were split anew for each match
    assert time.time() - began < 100


@pytest.mark.parametrize("size", [3, 7, 1024])
def test_rewriting_by_cells(spark, size):
    """Spans that touch, nest, overlap and cross cells, against Python."""
    rng, rows = random.Random(size), []
    for i in range(60):
        text = "".join(rng.choice("abc 😀é") for _ in range(rng.randint(1, 60)))
        spans = [(a, rng.randint(a + 1, len(text)), f"<{k}>") for k in "XY" for a in rng.sample(range(len(text)), min(len(text), rng.randint(0, 4)))]
        rows.append((i, text, spans))
    spans = spark.createDataFrame([(i, a, b, k) for i, _, s in rows for a, b, k in s], "uid long, start long, end long, label string")
    plan = spans_module.by_cell(spans, "uid", size=size)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "uid long, text string")
    got = {r["uid"]: r["out"] for r in texts.join(plan, "uid").select("uid", spans_module.rewritten(F.col("text"), F.col("cells"), size).alias("out")).collect()}
    for i, text, s in rows:
        if not s:
            continue
        out, done = "", 0
        for a, b, label in sorted(s, key=lambda x: (x[0], -x[1], x[2])):
            if b > done:
                out += text[done : max(a, done)] + label
                done = b
        assert got[i] == out + text[done:], (text, s)


def test_overlaps(spark):
    """Extra spans that touch a base one stay, those that share a code point go."""
    rows = [(1, 0, 5, 9), (1, 2, 0, 5), (1, 2, 4, 6), (1, 2, 9, 12), (1, 2, 8, 9), (1, 2, 3, 20), (1, 1, 30, 40), (1, 2, 30, 31), (1, 2, 25, 31), (2, 2, 5, 9)]
    got = spans_module.apart(spark.createDataFrame(rows, "uid long, place int, start long, end long"), 2).collect()
    assert {tuple(r) for r in got} == {(1, 0, 5, 9), (1, 1, 30, 40), (1, 2, 0, 5), (1, 2, 9, 12), (2, 2, 5, 9)}


def test_bare_copies_of_any_form(spark):
    """Short values, values without a digit, with dots, padding, or a first digit far in; words that others use aren't secrets."""
    values = ["hunter2", "correcthorse", "eyJh.bGci.x-y_z", "cGFkZGVk==", "z" * 300 + "7", "shared/word"]
    rows = [(i, f"password: {v}", "s1") for i, v in enumerate(values)] + [(10 + i, f"(see {v}).", "s2") for i, v in enumerate(values)] + [(20 + i, "about shared/word", f"s{i}") for i in range(4)]
    rows += [(30 + i, f"secret=within1owner {i}", "s9") for i in range(secrets.WIDE)] + [(60, "bare within1owner", "s9"), (61, "api_key='dotted1.'", "s1"), (62, "a dotted1. ", None), (None, "hunter2", "s2"), (None, "hunter2", "s2")]
    got = {}
    for r in secrets.digest(secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, v in enumerate(values[:-1]):
        assert got[10 + i][0]["spans"] == f"reuse:5:{5 + len(v)}", v
        assert got[i][0]["n_live"] == 1
    assert got[15][0]["spans"] == got[20][0]["spans"] == "" and got[5][0]["n_copied"] == 1
    assert got[60][0]["spans"] == "" and got[30][0]["n_copied"] == 1
    assert got[62][0]["spans"] == "reuse:2:9"
    assert [r["spans"] for r in got[None]] == ["reuse:0:7"] * 2
