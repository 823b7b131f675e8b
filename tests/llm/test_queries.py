"""The queries and the pipeline over whole tables against plain versions."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from govlattice.llm.queries import ORACLES, QUERIES

from . import plain
from .conftest import BASE


@pytest.fixture(scope="module")
def table(spark):
    return {n: [tuple(r) for r in spark.read.parquet(f"{BASE}/{n}.parquet").collect()] for n in ("documents", "benchmark")}


@pytest.fixture(scope="module")
def docs(table):
    return sorted((r[0], r[1]) for r in table["documents"])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_token_files(spark, docs):
    got = QUERIES["op1_token_files"](spark, BASE)
    wanted, at = Counter(), 0
    for i, t in docs:
        ids = plain.ids_of(t, 2)
        wanted[i, at, len(ids), plain.crc(ids)] += 1
        at += len(ids)
    assert Counter(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == wanted


def placed(rows, docs):
    """The pieces are those of the documents and lie gapless in sequences."""
    wanted = Counter()
    for i, t in docs:
        ids = plain.ids_of(t, 1)
        for k, a in enumerate(range(0, len(ids), 4096)):
            wanted[i, k, a, len(ids[a : a + 4096]), plain.crc(ids[a : a + 4096])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    return len(places), sum(k[3] * c for k, c in wanted.items())


def test_packing(spark, docs):
    sequences, total = placed(QUERIES["op4_best_fit_packing"](spark, BASE).collect(), docs)
    assert sequences <= -(-total // 4096) * 1.02 + 1


def test_near_duplicates(spark, docs):
    prints = [plain.simhash(t) for _, t in docs]
    wanted = Counter((i, f"{p:016x}", docs[g][0]) for (i, _), p, g in zip(docs, prints, plain.groups(prints)))
    got = QUERIES["op7_simhash_bk_trees"](spark, BASE).select("doc_id", "fingerprint", "component_id")
    assert Counter(map(tuple, got.collect())) == wanted


def test_repeats(spark, docs):
    wanted = Counter(
        (i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for (i, _), (n, spans, kept) in zip(docs, plain.repeats([t for _, t in docs]))
    )
    got = QUERIES["op10_suffix_array_dedup"](spark, BASE)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == wanted


def test_scores_of_counts(spark, docs):
    wanted = plain.unigrams(docs, docs)
    for r in QUERIES["op9_log_bilinear_scores"](spark, BASE).collect():
        n, known, total, base = wanted[r["doc_id"], dict(docs)[r["doc_id"]]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (plain.zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_pipeline(spark, docs, table):
    rest = [(i, t) for i, t in docs if plain.quality(t)[-1]]
    groups = plain.groups([plain.simhash(t) for _, t in rest])
    rest = [d for k, d in enumerate(rest) if groups[k] == k]
    cut = plain.repeats([t for _, t in rest], corpus_pipeline.PASSAGE_BYTES)
    rest = [(i, kept.decode("utf-8", "ignore")) for (i, _), (_, _, kept) in zip(rest, cut)]
    bad = plain.contamination(rest, [(r[0], r[1]) for r in table["benchmark"]])
    rest = [d for d, b in zip(rest, bad) if not b[-1]]
    assert len(docs) > len(rest) > len(docs) // 2
    placed(corpus_pipeline.run(spark, BASE).collect(), rest)


def test_stages_keep_columns_of_odd_documents(spark, odd, tmp_path):
    """Odd rows and further columns with clashing names pass through every stage."""
    from .conftest import documents

    spark.createDataFrame([(0, odd[14][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(500 + i, " ".join(f"word{'abcdefg'[i]}{j}" for j in range(80 + i))) for i in range(7)]
    df = documents(spark, [*odd, *clean, clean[0], (None, clean[1][1] + " end")], ("_text", "_id", "_k", "kept", "spans", "f", "n_words"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert df.select("doc_id").distinct().count() == 7
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
