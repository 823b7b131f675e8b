"""Collocations, line runs and whitening against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlattice.llm import collocations as grown
from govlattice.llm.collocations import collocations
from govlattice.llm.line_runs import Runs, drop_repeated_lines, repeated_lines
from govlattice.llm.queries import QUERIES
from govlattice.llm.whitening import exact_gram, refined_eigenvectors, whiten

from .conftest import BASE, documents
from .plain import lower


def plain_collocations(rows, top=2000, least=10, share=50):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        cover = Counter()
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for q in (p[:2], p[1:]):
                    cover[q] = max(cover[q], c)
        scored = []
        for p, a in f.items():
            if len(p) == 1 or a < least or (len(p) == 2 and cover[p] and 100 * cover[p] >= share * a):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrases(df, **args):
    return sorted(map(tuple, collocations(df, **args).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


TEXTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def wordy(seed, many=300):
    rng = random.Random(seed)
    words = ["a", "B", "c", "ë", "De", "of", "x1", "\x01q", "ÄB", "z z", "new york", "new york city", "los los", "п"]
    rows = []
    for _ in range(many):
        glue = [" ", "  ", "\t", ", ", ".", "\n", " ; "]
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts += [rng.choice(words), rng.choice(glue[:3] * 6 + glue)]
        rows.append(("".join(parts), rng.choice(["en", "en", None, "", "und", "fr"])))
    return rows


@pytest.mark.parametrize("top", [1, 3, 7, 2000])
def test_collocations_by_level(spark, top):
    """Small tops settle after one level or several; what is left on the frontier never changes the result."""
    rows = [*wordy(1), (None, None), ("", "en"), (". , !", "xx"), ("word " * 30_000, "fr"), *[("same words here today", "es")] * 12]
    df = spark.createDataFrame(rows, TEXTS)
    wanted = plain_collocations([(lang, text) for text, lang in rows], top)
    assert phrases(df, top=top) == wanted
    assert phrases(df, top=top, reach=1, share=100) == plain_collocations([(r[1], r[0]) for r in rows], top, share=100)


def test_collocations_of_the_table(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, BASE).collect())) == plain_collocations(rows)


def test_collocations_chunks_and_full_maps(spark, monkeypatch):
    """Chunks of a few bytes never cut a piece; a map that says yes to nearly all entries changes nothing."""
    rows = wordy(2, 120)
    df = spark.createDataFrame(rows, TEXTS).withColumns({"a": F.lit("x"), "score": F.lit(1), "w1": F.lit("y"), "c": F.lit(2)})
    wanted = plain_collocations([(lang, text) for text, lang in rows], 5)
    monkeypatch.setattr(grown, "SLICE", 40)
    monkeypatch.setattr(grown, "build_map", lambda entries: (1 << 16, np.full(1 << 13, 255, np.uint8)))
    assert phrases(df, top=5) == wanted
    assert phrases(spark.createDataFrame([], TEXTS)) == []
    assert phrases(spark.createDataFrame([(None, None), ("", None)], TEXTS)) == []


def plain_lines(rows, least_chars=20, least_docs=3):
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    split = [(i, [(x, strip.sub("", lower(x))) for x in (t or "").split("\n")]) for i, t in rows]
    holders = defaultdict(set)
    for (i, t), (_, lines) in zip(rows, split):
        for _, k in lines:
            if len(k) >= least_chars:
                holders[k].add((i, t or ""))
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, lines in split:
        kept = [
            x for x, k in lines
            if len(holders[k]) < least_docs or order(i) == max(order(j) for j, _ in holders[k])
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return Counter(out)


def lines_of(df, **args):
    cut = drop_repeated_lines(df, **args)
    return Counter(map(tuple, cut.select(df.columns[0], "n_lines", "n_dropped", F.sha2("kept", 256)).collect()))


def liney(seed, many=200):
    rng = random.Random(seed)
    pool = [f"  Repeated line number {k} " + "é" * (k % 3) for k in range(40)] + ["short", "", " \t ", "x" * 19, "Y" * 20, "\x0by" * 15]
    rows = []
    for i in range(many):
        lines = [rng.choice(pool + [f"line {rng.random()} of {i} only"] * 30) for _ in range(rng.randint(0, 25))]
        rows.append((i * 3 - 50, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_in_any_number_of_batches(spark, odd, batches):
    rows = [*liney(3), *odd, (9, None), (10, "x\n"), (11, "the very same line of text\n" * 4), (None, liney(3)[0][1])]
    rows += [(12, "the very same line of text"), (None, "The very same line of text\r"), (400, "tail\n" + "a long line of the tail\n" * 3000)]
    assert lines_of(documents(spark, rows, ("h", "at", "kept", "n", "top")), batches=batches) == plain_lines(rows)


def test_lines_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    got = QUERIES["op12_line_runs"](spark, BASE)
    wanted = plain_lines(rows)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == wanted
    assert sum(k[2] for k in wanted) > 0


def test_lines_of_nothing_and_of_one_id(spark):
    assert drop_repeated_lines(documents(spark, [])).count() == 0
    rows = [(7, f"one line that all of them hold\nand line {k} of its own here") for k in range(5)]
    assert lines_of(documents(spark, rows)) == plain_lines(rows)


def test_runs_hold_each_hash_once_and_are_compacted(spark):
    seen = []

    def watch(runs: Runs):
        counts = [df.count() for df in runs.all]
        union = runs.rows()
        assert union.select("h").distinct().count() == union.count() == sum(counts)
        seen.append(([len(level) for level in runs.levels], sum(counts)))

    df = documents(spark, liney(5))
    rows = df.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"), F.col("text").alias("_text"))
    repeated_lines(rows, least_chars=20, least_docs=3, batches=6, watch=watch).count()
    levels, sizes = zip(*seen)
    assert [list(x) for x in levels] == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    assert list(sizes) == sorted(sizes)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_runs_are_not_moved_by_the_anti_join(spark):
    runs = Runs(spark, fan=4)
    runs.add(spark.range(50).select(F.col("id").cast("string").cast("binary").alias("h")))
    plan = runs.fresh(spark.range(40, 60).select(F.col("id").cast("string").cast("binary").alias("h")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert len(re.findall(r"Exchange hashpartitioning\(h", text)) == 1  # the batch only
    assert plan.count() == 10
    runs.close()


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain_whitening(rows, most=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mid = np.array([float(Fraction(s, n)) for s in sums])
    x = np.array(fit, float) - mid
    cov = x.T @ x / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for i, row in kept:
        w = ((np.array(row, float) - mid) @ v) / np.sqrt(e)
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(row, sums)), np.abs(w), e / np.trace(cov)))
    return out


def check_vectors(df, rows):
    wanted = plain_whitening(rows)
    got = defaultdict(list)
    for r in df.collect():
        got[r["vec_id"]].append(r)
    assert set(got) == set(wanted)
    for i, parts in wanted.items():
        width = len(parts[0][3])
        assert len(got[i]) == width * len(parts)
        for n, deviation, w, explained in parts:
            mine = [r for r in got[i] if int(r["deviation"]) == deviation]
            for k in range(width):
                r = [r for r in mine if r["component"] == k + 1]
                assert r and all(x["n"] == n and x["identity_error"] <= 1e-9 for x in r)
                assert min(abs(abs(x["whitened"]) - w[k]) for x in r) < 1e-7
                assert r[0]["explained"] == pytest.approx(explained[k], rel=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (300, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += rows[:5] + [(900 + i, rows[0][1]) for i in range(200)] + [(3, rows[9][1]), (None, rows[11][1])]
    bad = [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [math.inf] + [0.0] * 5), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({"_id": F.lit("x"), "_x": F.lit(1), "n": F.lit(2)})
    check_vectors(whiten(df), rows)
    check_vectors(whiten(df.repartition(7)), rows)


def test_whitening_of_the_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op13_refined_whitening"](spark, BASE)
    assert got.schema["deviation"].dataType == T.LongType()
    check_vectors(got, rows)


def test_whitening_is_the_same_whatever_the_partitions(spark):
    df = spark.read.parquet(f"{BASE}/embeddings.parquet")
    one, other = (
        sorted((r["vec_id"], r["component"], r["explained"], r["whitened"]) for r in whiten(d).collect())
        for d in (df.coalesce(1), df.repartition(13))
    )
    assert [r[:3] for r in one] == [r[:3] for r in other]
    # The model is the same; a projection may be summed in another order.
    assert max(abs(a[3] - b[3]) for a, b in zip(one, other)) < 1e-13


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whiten(none).count() == 0 and whiten(none).columns[0] == "vec_id"
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], VECTORS)
    assert {r["component"] for r in whiten(flat).collect()} == {1}


def test_exact_products_of_large_numbers():
    rng = np.random.default_rng(1)
    for bits in (3, 22, 40, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (5000, 3))
        assert (exact_gram(y) == y.astype(object).T @ y.astype(object)).all()


@pytest.mark.parametrize("values", [
    [3.0, 2.0, 1.0, 0.5, 0.25, 0.1],
    [1.0, 1 - 1e-9, 1 - 2e-9, 0.4, 0.4, 0.4 - 1e-12],
    [1.0] * 6,
    [1.0, 1e-3, 1e-6, 1e-9, 0.0, 0.0],
    [5.0, 5.0 - 1e-7, 5.0 - 1e-13, 1.0, 1.0 + 1e-10, 0.0],
])
def test_clustered_eigenvalues(values):
    """Eigenvectors of close eigenvalues are right to double precision times one over their gap."""
    size = 24
    values = np.array(values + list(np.linspace(0.05, 0.01, size - len(values))), np.longdouble)
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(size) - q.T @ q) / 2
    a = (q * values) @ q.T
    found, x = refined_eigenvectors((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    assert np.abs(found - values[order]).max() < 1e-17 * 40
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-16
    for k, at in enumerate(order):
        gap = np.abs(np.delete(values, at) - values[at]).min()
        if gap > 1e-13:
            assert abs(1 - abs(x[:, k] @ q[:, at])) < max(1e-16, (1e-17 / gap) ** 2)
