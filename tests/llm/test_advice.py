"""Whole jobs of the pipeline's stages and of op6_pii against brute force."""

import math
import random
import re
from collections import defaultdict

import corpus_pipeline
from quarry.llm import minhash, pii
from tests.conftest import DATA
from tests.llm.conftest import words
from tests.llm.test_minhash import shingle_set
from tests.llm.test_vectors import components


def kept_at(rows: list[tuple[int, str | None]], percent: int) -> set[int]:
    """The least id of each component, by shared shingles of all pairs."""
    sets, holders, common = {i: shingle_set(t) for i, t in rows}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            for j in holders[g]:
                common[j, i] += 1
            holders[g].append(i)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = components(set(sets), links)
    return {i for i in sets if root[i] == i}


def test_near_dedup_stage_links_from_80_percent(spark):
    """Copies whose similarity lies between 0.80 and 0.85, and the test data."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        text = words(rng, 104).split()
        rows.append((2 * i, " ".join(text)))
        # two words change ten of 100 shingles: 90 of 110 are shared, which is 0.82
        text[30] = text[60] = "changed"
        rows.append((2 * i + 1, " ".join(text)))
    at_80, at_85 = kept_at(rows, 80), kept_at(rows, 85)
    assert len(at_80) == 40 and len(at_85) == 80
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, DATA).collect()} == at_80
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()} == kept_at([(r["doc_id"], r["text"]) for r in docs.collect()], 80)


def test_bands_of_each_threshold():
    """The query's bands stay as they are; the stage's miss no more pairs at its own threshold."""
    assert minhash.layout(85) == (21, 6)
    bands, rows = minhash.layout(80)
    assert bands * rows <= minhash.MINIMA and (1 - 0.8**rows) ** bands <= 1e-4


def disclosing_brute(texts: list[str], entity: str) -> set[tuple[int, int, int]]:
    """document, start, end of each occurrence of a term that discloses an entity of the pattern, by the formula."""
    found = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", t) if m.end() - m.start() >= pii.LETTERS] for t in texts]
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for m in re.finditer(entity, t):
            holders[m[0].lower()].add(i)
    docs_of = defaultdict(set)
    for i, ws in enumerate(found):
        for *_, w in ws:
            docs_of[w].add(i)
    out, n = set(), len(texts)
    for docs in holders.values():
        for w, those in docs_of.items():
            n_te = len(docs & those)
            if n_te >= pii.SUPPORT and len(docs) < n and math.log(n_te * n / (len(those) * len(docs))) / math.log(n / len(docs)) >= pii.DISCLOSURE:
                out |= {(i, a, b) for i in docs for a, b, v in found[i] if v == w and not any(a < m.end() and m.start() < b for m in re.finditer(entity, texts[i]))}
    return out


def term_spans(spark, texts: list[str]) -> set[tuple[int, int, int]]:
    got = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    return {(r["doc_id"], *map(int, s.split(":")[1:])) for r in got for s in r["spans"].split(",") if s.startswith("term:")}


def test_terms_far_from_their_entity(spark):
    """A name at the head and the foot of long letters, the address between them."""
    rng = random.Random(3)
    filler = ["ordinary", "letters", "about", "weather", "garden"]
    texts = [" ".join(rng.choice(filler) for _ in range(40)) for _ in range(80)]
    for i in range(4):
        texts[i] = f"Office of QUILLFEATHER {texts[i]} mail q0@site.org or {i % 2}@site.org, {texts[i]} signed Quillfeather"
    texts[9] += " q0@site.org"  # a document with the address alone
    want = disclosing_brute(texts, r"[a-z0-9]+@site\.org")
    assert {(i, texts[i].index("QUILLFEATHER")) for i in range(4)} <= {(i, a) for i, a, _ in want}
    assert term_spans(spark, texts) == want


def test_numbers_and_neighbours_end_no_context(spark):
    """A year and a price stand between a name and a card, and addresses of a list between a name and an address."""
    texts = [f"ordinary letters about weather {i}" for i in range(60)]
    for i in range(3):
        texts[i] = "Quillfeather paid 120 in 2024 by 4111 1111 1111 1111, 35 left ordinary letters"
    for i in range(3, 6):
        texts[i] = "Marblewick a0@x.org, b0@x.org, c0@x.org ordinary letters"
    want = disclosing_brute(texts, r"4111 1111 1111 1111|[a-z0-9]+@x\.org")
    assert {(i, 0) for i in range(6)} <= {(i, a) for i, a, _ in want}
    assert term_spans(spark, texts) == want
