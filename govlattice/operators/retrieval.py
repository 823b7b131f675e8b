"""Exact cosine retrieval over dense vectors and over hashed TF-IDF texts.

Queries are tables of any size. Dense rows are packed into chunks where they
are and meet blocks of queries as matrix products. So do the sparse vectors of
texts while the queries are few blocks. More queries search the texts through
an inverted index whose postings lie in blocks of falling impact: the first
blocks give each query a threshold, upper bounds then rule out most blocks and
documents, and only what is left is scored in full. Nothing but counts comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlattice.functions.text import words
from govlattice.session import bounded_rows, cut_lineage
from govlattice.sources.corpus import indexing_text

QUERIES_PER_BLOCK = 256
ROWS_PER_CHUNK = 4_096
# Blocks of queries that are broadcast; more are joined by their number.
BLOCKS_HELD = 64
HASH_SPACE = 65_536
ROUND = 6


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def _merge_best(best: list, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Keep the k best (score, id) per query; ties go to the smaller id."""
    for q in range(scores.shape[0]):
        s = np.concatenate([best[q][0], scores[q]])
        i = np.concatenate([best[q][1], ids])
        if s.size > 4 * k:
            # Everything at least as good as the k-th, ties included.
            kth = np.partition(s, s.size - k)[s.size - k]
            keep = s >= kth
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[:k]
        best[q] = (s[order], i[order])


def _fresh(n: int) -> list:
    return [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in range(n)]


def _top_k(partial: DataFrame, id_name: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_name)
    return (
        partial.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", id_name, "rank", F.round("score", 4).alias("score"))
    )


def _units(flat: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a packed chunk or block."""
    held = ids.to_numpy(zero_copy_only=False)
    x = flat.to_numpy(zero_copy_only=False).reshape(len(held), -1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return held, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _chunks(rows: DataFrame, most: int) -> DataFrame:
    """Vectors (``_id``, ``_v``) packed where they are: ``ids``, ``flat``, at most ``most`` rows each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids, flat = part.column(0), part.column(1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                    ],
                    ["ids", "flat"],
                )

    return rows.mapInArrow(pack, "ids array<bigint>, flat array<double>")


def nearest_vectors(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    item: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """The k most similar corpus rows of every query: query_id, item, rank, score.

    Every chunk of corpus rows meets every block of queries as one matrix
    product and gives k rows a query; the best of these are ranked at the end.
    Up to 64 blocks of about 256 queries are broadcast, more are joined by
    number. Ties go to the smaller item.
    """
    k = max(1, k)
    wide = "array<double>"
    asked = queries.select(F.col(query_id).cast("bigint").alias("_id"), F.col(query_vector).cast(wide).alias("_v"))
    many = -(-asked.count() // QUERIES_PER_BLOCK) or 1
    number = F.pmod(F.xxhash64("_id"), F.lit(many)).cast("int").alias("block")
    blocks = asked.groupBy(number).agg(F.collect_list(F.struct("_id", "_v")).alias("_q"))
    blocks = blocks.select(
        "block", F.col("_q._id").alias("asked"), F.flatten(F.transform("_q", lambda q: q["_v"])).alias("wanted")
    )
    rows = corpus.select(F.col(item).cast("bigint").alias("_id"), F.col(vector).cast(wide).alias("_v"))
    chunks = _chunks(rows, ROWS_PER_CHUNK).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    met = chunks.join(F.broadcast(blocks) if many <= BLOCKS_HELD else blocks, "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, x = _units(batch.column(1)[i].values, batch.column(0)[i].values)
                asked, q = _units(batch.column(3)[i].values, batch.column(2)[i].values)
                best = _fresh(len(asked))
                _merge_best(best, np.round(q @ x.T, ROUND), held, k)
                arrays = [
                    np.repeat(asked, [len(s) for s, _ in best]),
                    np.concatenate([j for _, j in best]),
                    np.concatenate([s for s, _ in best]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", item, "score"])

    packed = met.select("ids", "flat", "asked", "wanted")
    return _top_k(packed.mapInArrow(score, f"query_id bigint, {item} bigint, score double"), item, k)


# -- texts -----------------------------------------------------------------------------


def term_buckets(text: Column) -> Column:
    """Hash bucket of every word of a text, in order."""
    return F.transform(
        words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    )


def document_frequencies(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Documents per bucket: at most 65,536 rows whatever the corpus."""
    return (
        corpus.select(F.explode(F.array_distinct(term_buckets(F.col(text)))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def fit_idf(corpus: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequencies, ln((n+1)/(df+1)), as one bounded array."""
    n = corpus.count()
    idf = np.full(HASH_SPACE, np.log(n + 1.0))
    for row in document_frequencies(corpus, text).collect():
        idf[row["bucket"]] = np.log((n + 1.0) / (row["df"] + 1.0))
    return idf


def _weights(buckets, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(np.asarray(buckets, dtype=np.int64), return_counts=True)
    w = tf * idf[at]
    norm = np.sqrt(np.sum(w * w))
    return at, (w / norm if norm > 0 else w)


def build_text_index(
    corpus: DataFrame, item: str, text: str = "text", idf: np.ndarray | None = None
) -> DataFrame:
    """Unit-length sparse vectors: item, buckets, weights."""
    weights = fit_idf(corpus, text) if idf is None else idf

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [_weights(b, weights) for b in pdf["_b"]]
            yield pd.DataFrame(
                {
                    item: pdf[item],
                    "buckets": [p[0].astype("int32") for p in pairs],
                    "weights": [p[1] for p in pairs],
                }
            )

    rows = corpus.select(F.col(item).cast("bigint").alias(item), term_buckets(F.col(text)).alias("_b"))
    return rows.mapInPandas(vectors, f"{item} bigint, buckets array<int>, weights array<double>")


# Rounded scores are compared, so bounds leave this much room.
SLACK = 2.0 * 10**-ROUND
# Postings a query looks at for its threshold.
PROBE = 64
# Part of the threshold that unread terms may make up: the less, the more lists are read, and the fewer texts stay.
UNREAD = 0.25
# Blocks of queries that meet every text; more are searched through postings.
BLOCKS_SCANNED = 8
TEXTS_PER_CHUNK = 1_024
# Products of weights that are summed at once.
PRODUCTS = 1 << 20


def impact_postings(index: DataFrame, item: str) -> DataFrame:
    """``bucket``, ``level``, item, ``w``: one row for each weight, in blocks of falling impact.

    The weights of a block differ by a fifth at most: level n holds those from
    2^(-n/4) on. A block is a label, never gathered, so a bucket that most texts
    have is no large group.
    """
    rows = index.select(item, F.explode(F.arrays_zip("buckets", "weights")).alias("_p"))
    flat = rows.select(F.col("_p.buckets").alias("bucket"), item, F.col("_p.weights").alias("w")).filter("w > 0")
    return flat.withColumn("level", F.ceil(-4 * F.log2("w")).cast("int"))


def _bounded_blocks(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """Every block of every query term: ``bound`` of its share in a score, ``ub`` of the term's."""
    blocks = terms.join(stats, "bucket").withColumn("bound", F.col("qw") * F.col("top"))
    best = F.max("bound").over(Window.partitionBy("query_id", "bucket"))
    return blocks.withColumn("ub", best)


def _thresholds(blocks: DataFrame, postings: DataFrame, vectors: DataFrame, index: DataFrame, item: str, k: int) -> DataFrame:
    """``query_id``, ``theta``: a score that k texts reach at least.

    The texts of each query's strongest blocks are ranked by what they get from
    those, and the first few scored in full.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket", "level")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    probe = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < PROBE * k)
    part = probe.join(postings, ["bucket", "level"]).groupBy("query_id", item).agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    by_part = Window.partitionBy("query_id").orderBy(F.desc("s"), item)
    first = part.withColumn("_r", F.row_number().over(by_part)).filter(F.col("_r") <= 8 * k)
    scored = _full_scores(first, vectors, index, item)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scored.withColumn("_r", rank).filter(F.col("_r") == k).select("query_id", F.col("score").alias("theta"))


def _promising(blocks: DataFrame, thresholds: DataFrame, postings: DataFrame, item: str) -> DataFrame:
    """``query_id``, item: a superset of all texts that reach their query's threshold.

    Terms whose bounds together stay below a part of the threshold are not read
    at all; of the others only blocks are read that can reach it along with the
    bounds of all other terms. A text's sum over those, plus the bounds of the
    terms left out, decides whether it stays.
    """
    limit = F.coalesce("theta", F.lit(0.0)) - SLACK
    terms = blocks.select("query_id", "bucket", "ub").distinct()
    by_bound = Window.partitionBy("query_id").orderBy("ub", "bucket")
    judged = (
        terms.withColumn("_up", F.sum("ub").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("ub").over(Window.partitionBy("query_id")))
        .join(thresholds, "query_id", "left")
        .withColumn("_limit", limit)
        .withColumn("_carries", F.col("_up") >= UNREAD * F.col("_limit"))
    )
    rest = F.sum(F.when(~F.col("_carries"), F.col("ub")).otherwise(0.0)).over(Window.partitionBy("query_id"))
    judged = judged.withColumn("_rest", rest).filter("_carries").drop("ub")
    read = blocks.join(judged, ["query_id", "bucket"]).filter(F.col("bound") + F.col("_all") - F.col("ub") >= F.col("_limit"))
    sums = read.join(postings, ["bucket", "level"]).groupBy("query_id", item).agg(
        F.sum(F.col("qw") * F.col("w")).alias("_s"), F.first("_rest").alias("_rest"), F.first("_limit").alias("_limit")
    )
    return sums.filter(F.col("_s") + F.col("_rest") >= F.col("_limit")).select("query_id", item)


def _full_scores(pairs: DataFrame, vectors: DataFrame, index: DataFrame, item: str) -> DataFrame:
    """``query_id``, item, ``score`` of pairs, from both whole vectors."""
    asked = vectors.select("query_id", F.col("buckets").alias("_qb"), F.col("weights").alias("_qw"))
    both = pairs.join(asked, "query_id").join(index, item).select("query_id", item, "_qb", "_qw", "buckets", "weights")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            columns = [batch.column(c) for c in range(2, 6)]
            for i in range(batch.num_rows):
                qb, qw, b, w = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
                at = np.searchsorted(b, qb)
                at[at == len(b)] = 0
                hit = b[at] == qb
                found[i] = (qw[hit] * w[at[hit]]).sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.round(found, ROUND))], ["query_id", item, "score"]
            )

    return both.mapInArrow(score, f"query_id bigint, {item} bigint, score double")


def _by_postings(vectors: DataFrame, index: DataFrame, item: str, k: int) -> DataFrame:
    """``query_id``, item, ``score`` of a superset of the k best texts of every query, through postings."""
    postings = cut_lineage(impact_postings(index, item))
    # At most 65,536 buckets, each with a few dozen levels.
    stats = postings.groupBy("bucket", "level").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("n"))
    terms = vectors.select("query_id", F.explode(F.arrays_zip("buckets", "weights")).alias("_t"))
    terms = terms.select("query_id", F.col("_t.buckets").alias("bucket"), F.col("_t.weights").alias("qw")).filter("qw > 0")
    blocks = cut_lineage(_bounded_blocks(terms, stats))
    thresholds = cut_lineage(_thresholds(blocks, postings, vectors, index, item, k))
    return _full_scores(_promising(blocks, thresholds, postings, item), vectors, index, item)


def _sparse_chunks(index: DataFrame, item: str) -> DataFrame:
    """Sparse vectors packed where they are: ``ids``, ``sizes``, and the flat ``b`` and ``w``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_CHUNK):
                ids, b, w = batch.slice(at, TEXTS_PER_CHUNK).columns
                lists = [ids, b.value_lengths(), b.flatten(), w.flatten()]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "sizes", "b", "w"])

    rows = index.select(item, "buckets", "weights").filter(F.col(item).isNotNull())
    return rows.mapInArrow(pack, "ids array<bigint>, sizes array<int>, b array<int>, w array<double>")


def _products(b: np.ndarray, w: np.ndarray, row: np.ndarray, n: int, qb: np.ndarray, qw: np.ndarray, qrow: np.ndarray, m: int) -> np.ndarray:
    """Sums of the products of equal buckets, n texts by m queries, a bounded number of products at a time."""
    order = np.argsort(qb, kind="stable")
    qb, qw, qrow = qb[order], qw[order], qrow[order]
    first = np.searchsorted(qb, b)
    met = np.searchsorted(qb, b, side="right") - first
    b, w, row, first, met = (x[met > 0] for x in (b, w, row, first, met))
    sums = np.zeros(n * m)
    part = np.cumsum(met) // PRODUCTS
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    for start, end in zip(starts, [*starts[1:], len(part)]):
        many = met[start:end]
        own = np.repeat(np.arange(start, end), many)
        other = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[own]
        sums += np.bincount(row[own] * m + qrow[other], w[own] * qw[other], n * m)
    return sums.reshape(n, m)


def _scanned(vectors: DataFrame, index: DataFrame, item: str, k: int, many: int) -> DataFrame:
    """``query_id``, item, ``score`` of the k best texts of every chunk, for every query that shares a word with them.

    A chunk of texts meets a block of queries at a time, so a task holds no more
    of a larger corpus, and the texts are not moved.
    """
    number = F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("block")
    asked = vectors.filter("query_id IS NOT NULL").groupBy(number).agg(
        F.collect_list(F.struct("query_id", "buckets", "weights")).alias("_q")
    )
    blocks = asked.select(
        F.col("_q.query_id").alias("asked"),
        F.transform("_q", lambda q: F.size(q["buckets"])).alias("lengths"),
        F.flatten("_q.buckets").alias("qb"),
        F.flatten("_q.weights").alias("qw"),
    )
    met = _sparse_chunks(index, item).crossJoin(F.broadcast(blocks))

    def best(ids, sizes, b, w, asked, lengths, qb, qw) -> tuple[np.ndarray, ...]:
        n, m = len(ids), len(asked)
        ends, q_ends = np.cumsum(sizes), np.cumsum(lengths)
        row, qrow = np.repeat(np.arange(n), sizes), np.repeat(np.arange(m), lengths)
        sums = _products(b, w, row, n, qb, qw, qrow, m)
        least = np.partition(sums, n - k, axis=0)[n - k] if n > k else np.zeros(m)
        at, of = np.nonzero((sums > 0) & (sums >= least - SLACK))
        scores = np.empty(len(at))
        for i, (text, query) in enumerate(zip(at, of)):
            # Summed as in _full_scores.
            own = slice(ends[text] - sizes[text], ends[text])
            other = slice(q_ends[query] - lengths[query], q_ends[query])
            spot = np.searchsorted(b[own], qb[other])
            spot[spot == sizes[text]] = 0
            hit = b[own][spot] == qb[other]
            scores[i] = (qw[other][hit] * w[own][spot[hit]]).sum()
        scores = np.round(scores, ROUND)
        order = np.lexsort((ids[at], -scores, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        order = order[place < k]
        return asked[of[order]], ids[at[order]], scores[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in best(*held)], ["query_id", item, "score"])

    return met.mapInArrow(score, f"query_id bigint, {item} bigint, score double")


def _filled(ranked: DataFrame, queries: DataFrame, index: DataFrame, item: str, k: int) -> DataFrame:
    """Queries with fewer than k texts get the smallest other items, with score 0."""
    counts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    few = queries.join(counts, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    first = index.select(item).orderBy(item).limit(2 * k)
    pairs = few.filter(F.col("_n") < k).join(F.broadcast(first))
    other = pairs.join(ranked.select("query_id", item), ["query_id", item], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(item))
    extra = other.withColumn("rank", (F.col("_n") + rank).cast("int")).filter(F.col("rank") <= k)
    return ranked.unionByName(extra.select("query_id", item, "rank", F.lit(0.0).alias("score")))


def search_index(
    index: DataFrame,
    queries: DataFrame,
    idf: np.ndarray,
    item: str,
    k: int = 3,
    query_id: str = "query_id",
    text: str = "text",
) -> DataFrame:
    """The k most similar indexed texts of every query text: query_id, item, rank, score.

    Exact: scores are those of whole vectors, ties go to the smaller item, and a
    query that shares no word with k texts gets the smallest items, at 0. Query
    ids and items must not repeat.
    """
    k = max(1, k)
    held = cut_lineage(index)
    named = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(text).alias("text"))
    vectors = cut_lineage(build_text_index(named, "query_id", "text", idf))
    many = -(-vectors.count() // QUERIES_PER_BLOCK) or 1
    found = _scanned(vectors, held, item, k, many) if many <= BLOCKS_SCANNED else _by_postings(vectors, held, item, k)
    ranked = cut_lineage(_top_k(found, item, k))
    return _filled(ranked, vectors.select("query_id"), held, item, k)


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    item: str,
    k: int = 3,
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
) -> DataFrame:
    """Index a corpus and search it in one go."""
    idf = fit_idf(corpus, text)
    index = build_text_index(corpus, item, text, idf)
    return search_index(index, queries, idf, item, k, query_id, query_text)


SMALL_CORPUS = 4_096


def nearest_of_small_corpus(
    rows: DataFrame, corpus: DataFrame, text: str, k: int = 3, name: str = "nearest"
) -> DataFrame:
    """Add the k best passages of a small corpus to every row of a large table.

    The passages (checked to be few) travel with the task; rows stay where they
    are. ``corpus``: source, article, text, and optionally tema, which then
    leads the text a passage is found by.
    """
    chunk = F.col("text")
    if "tema" in corpus.columns:
        chunk = indexing_text(chunk, F.col("tema"))
    held = bounded_rows(
        corpus.select("source", "article", "text", term_buckets(chunk).alias("_b")).orderBy("source"),
        SMALL_CORPUS,
        "corpus",
    )
    n = len(held)
    counts = np.zeros(HASH_SPACE)
    for r in held:
        counts[np.unique(np.asarray(r["_b"], dtype=np.int64))] += 1
    idf = np.log((n + 1.0) / (counts + 1.0))
    used = np.flatnonzero(counts)
    column = np.full(HASH_SPACE, -1, dtype=np.int32)
    column[used] = np.arange(used.size)
    matrix = np.zeros((n, used.size))
    for i, r in enumerate(held):
        at, w = _weights(r["_b"], idf)
        matrix[i, column[at]] = w
    keep = max(1, min(k, n)) if n else 0

    def best(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            at, w = _weights(b, idf)
            hit = column[at] >= 0
            scores = np.round(matrix[:, column[at][hit]] @ w[hit], ROUND)
            order = np.argsort(-scores, kind="stable")[:keep]
            out.append([{"at": int(i), "score": float(scores[i])} for i in order])
        return pd.Series(out)

    picked = F.pandas_udf(best, "array<struct<at:int,score:double>>")(term_buckets(F.col(text)))
    passages = F.array(
        *[
            F.struct(
                F.lit(r["source"]).alias("source"),
                F.lit(r["article"]).cast("string").alias("article"),
                F.lit(r["text"]).alias("text"),
            )
            for r in held
        ]
    ).cast("array<struct<source:string,article:string,text:string>>")

    def passage(p: Column) -> Column:
        chosen = F.get(passages, p["at"])
        return F.struct(
            chosen["source"].alias("source"),
            chosen["article"].alias("article"),
            chosen["text"].alias("text"),
            F.round(p["score"], 4).alias("score"),
        )

    out = rows.withColumn("_picked", picked)
    return out.withColumn(name, F.transform("_picked", passage)).drop("_picked")
