"""Retrieval of query tables against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from govlattice.operators import retrieval as R

BASE = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


def plain_search(docs, queries, k):
    """The k best of all documents for every query, by whole vectors."""

    def counts(text):
        return Counter(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in WORD.findall(text.lower()))

    bags = {i: counts(t) for i, t in docs.items()}
    df = Counter(b for bag in bags.values() for b in bag)
    idf = {b: np.log((len(docs) + 1.0) / (df[b] + 1.0)) for b in range(R.HASH_SPACE)}

    def unit(bag):
        w = {b: n * idf[b] for b, n in bag.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {b: x / norm if norm > 0 else x for b, x in w.items()}

    ids = sorted(docs)
    matrix = np.zeros((len(ids), R.HASH_SPACE))
    for row, i in enumerate(ids):
        for b, x in unit(bags[i]).items():
            matrix[row, b] = x
    out = {}
    for q, text in queries.items():
        wanted = unit(counts(text))
        scores = np.round(matrix[:, list(wanted)] @ np.array(list(wanted.values())), R.ROUND) if wanted else np.zeros(len(ids))
        best = sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r]))[:k]
        out[q] = [(ids[r], scores[r]) for r in best]
    return out


def matches(found, wanted):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert set(got) == set(wanted)
    for q, best in wanted.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        for (_, doc, score), (plain_doc, plain_score) in zip(mine, best):
            assert score == pytest.approx(plain_score, abs=1.1e-4)
            # Sums in another order may swap texts whose scores agree to six places.
            assert doc == plain_doc or any(abs(s - plain_score) < 2e-6 and d == doc for d, s in best)


def test_five_thousand_queries(spark):
    rows = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").limit(150).collect()
    docs = {r["doc_id"]: r["text"] for r in rows}
    rng = np.random.default_rng(4)
    words = sorted({w for t in docs.values() for w in t.split()})
    queries = {q: " ".join(rng.choice(words, rng.integers(1, 9))) for q in range(5_000)}
    queries |= {5_000: "", 5_001: "zzzz qqqq unheard", 5_002: rows[3]["text"], 5_003: "the of and " * 40}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    matches(R.retrieve(corpus, asked, "doc_id", k=3).collect(), plain_search(docs, queries, 3))


def test_more_wanted_than_there_is(spark):
    docs = {1: "alpha beta", 2: "beta gamma", 9: "gamma delta delta"}
    queries = {1: "beta", 2: "nothing", 3: "delta alpha"}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    matches(R.retrieve(corpus, asked, "doc_id", k=7).collect(), plain_search(docs, queries, 7))
    assert R.retrieve(corpus, asked.limit(0), "doc_id").count() == 0
    assert R.retrieve(corpus.limit(0), asked, "doc_id").count() == 0


def test_postings_lie_in_blocks_of_falling_impact(spark):
    index = spark.createDataFrame([(1, [5, 9], [0.6, 0.8]), (2, [5], [1.0]), (3, [5, 7], [0.05, 0.0])], "d bigint, buckets array<int>, weights array<double>")
    rows = {(r["bucket"], r["d"]): (r["level"], r["w"]) for r in R.impact_postings(index, "d").collect()}
    assert set(rows) == {(5, 1), (9, 1), (5, 2), (5, 3)}
    assert all(2 ** (-level / 4) <= w * (1 + 1e-12) for level, w in rows.values())
    assert rows[5, 2][0] < rows[5, 1][0] < rows[5, 3][0]


@pytest.mark.parametrize("held", [64, 2])
def test_blocks_of_dense_queries(spark, monkeypatch, held):
    """Blocks that are broadcast and blocks that are joined give the same, chunk by chunk."""
    monkeypatch.setattr(R, "BLOCKS_HELD", held)
    monkeypatch.setattr(R, "ROWS_PER_CHUNK", 37)
    rng = np.random.default_rng(5)
    x, q = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (1_500, 5)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, query_vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in R.nearest_vectors(corpus, asked, 4).collect()}
    assert len(found) == 4 * len(q)

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(q) @ unit(x).T, R.ROUND)
    for i in range(len(q)):
        for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (-scores[i, j], j))[:4], 1):
            doc, score = found[i, rank]
            assert score == pytest.approx(scores[i, j], abs=1e-4) and abs(scores[i, doc] - scores[i, j]) < 2e-6
    assert R.nearest_vectors(corpus, asked.filter(F.lit(False)), 4).count() == 0


@pytest.mark.parametrize("scanned", [8, 0])
def test_texts_meet_few_queries_where_they_are(spark, monkeypatch, scanned):
    """A corpus is packed chunk by chunk; postings, which are sorted and gathered, are for many queries only."""
    monkeypatch.setattr(R, "BLOCKS_SCANNED", scanned)
    monkeypatch.setattr(R, "TEXTS_PER_CHUNK", 23)
    monkeypatch.setattr(R, "PRODUCTS", 50)
    monkeypatch.setattr(R, "QUERIES_PER_BLOCK", 100)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(rng.choice(words, rng.integers(0, 30))) for i in range(300)}
    docs |= {1_000 + i: docs[i] for i in range(40)}
    queries = {q: " ".join(rng.choice(words, rng.integers(0, 7))) for q in range(250)} | {900: "unheard", 901: docs[7]}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    built, postings = [], R.impact_postings
    monkeypatch.setattr(R, "impact_postings", lambda *a: built.append(a) or postings(*a))
    matches(R.retrieve(corpus, asked, "doc_id", k=4).collect(), plain_search(docs, queries, 4))
    assert bool(built) == (scanned == 0)
