"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

Words are counted exactly over all training texts. The model has two levels.
Above are classes: frequent words, the end of a text, and buckets of all other
words by their last letters. Below, each other word that is seen at least
``Settings.least`` times has a vector of its own, so that the model grows with
the corpus. The energy for class w after class h is bilinear,

    s(w | h) = r(h) . q(w) + b(w),

with learned vectors r and q. Training tells the observed pairs of classes from
pairs drawn from the noise (class frequencies): pair counts over all training
texts are a table of bounded size, so the expected noise-contrastive objective
is computed on them exactly, as matrix products. Normalised log-probabilities
of all pairs come from one matrix product.

A word w of a bucket has after h the weight (count + 1) exp(r(h) . q(w)), with
the learned contexts r of above (their main directions and a constant) and a
vector q(w) that tells its pairs from pairs drawn by frequency in its bucket. The
contexts being given, each word's objective stands for itself and is concave, so
words are spread over tasks, each a batch of matrix products. Words seen less
often, and all unseen ones together as a word of count 0, have no vector. Weights
are summed by bucket and context over all words, so the whole is a distribution.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.llm.common import list_of, slices, utf8_parts
from govlattice.session import bounded_rows, cut_lineage

# The end of a text; not a word, since it holds a blank.
END = b" end"
# Distinct words a task counts before it passes them on.
HELD_WORDS = 500_000
# Pairs of a context and a word that a task gathers before it counts them.
HELD_PAIRS = 4_000_000
# Words whose vectors are learned together.
WORD_BATCH = 256


@dataclass(frozen=True)
class Settings:
    words: int = 767  # frequent words that are classes of their own
    buckets: int = 256  # classes of all other words
    known_words: int = 200_000  # words whose counts and vectors every task holds; the others are joined
    least: int = 16  # words outside the classes have vectors from this count on
    inner_width: int = 8  # directions of the contexts that these vectors see
    inner_steps: int = 5
    shrink: float = 2.0  # strength of the penalty on these vectors
    width: int = 48
    noise: int = 10  # noise pairs for each observed one
    steps: int = 200
    rate: float = 0.05
    seed: int = 7

    @property
    def classes(self) -> int:
        return self.words + 1 + self.buckets


def bucket_of(word: bytes, settings: Settings) -> int:
    return settings.words + 1 + zlib.crc32(word[-3:]) % settings.buckets


def _held_out(id_column: str) -> Column:
    part = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(7))
    return F.coalesce(part == 2, F.lit(False))


def count_words(rows: DataFrame) -> DataFrame:
    """``word`` (binary) and ``c``: counts of all words and of the end over ``_text``."""

    def work(batches):
        counts: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"]
            )
            counts.clear()
            return out

        for batch in slices(batches, "_text", 2 << 20):
            for text in utf8_parts(batch.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
            if len(counts) > HELD_WORDS:
                yield emit()
        if counts:
            yield emit()

    parts = rows.select("_text").mapInArrow(work, "word binary, c bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def classes_of(words: list[bytes], settings: Settings) -> np.ndarray:
    """Classes of words in falling order of their counts: the first ones get their own."""
    own = {w: i for i, w in enumerate([w for w in words if w != END][: settings.words])} | {END: settings.words}
    return np.array([own[w] if w in own else bucket_of(w, settings) for w in words], np.int32)


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Up to ``most`` of the most frequent words and their counts, in falling order (ties: by word).

    A histogram over logarithmic ranges of the counts gives the range from which
    on words are taken, all or none of a range, so nothing is sorted globally.
    """
    rank = F.floor(F.log2("c") * 32).cast("int")
    ranges = bounded_rows(counts.groupBy(rank.alias("r")).agg(F.count(F.lit(1)).alias("n")), 64 * 32, "ranges")
    least, total = 64 * 32, 0
    for r in sorted(ranges, key=lambda r: -r["r"]):
        total += r["n"]
        if total > most:
            break
        least = r["r"]
    top = counts.filter(rank >= least).toArrow()
    words, held = top.column(0).to_pylist(), top.column(1).to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-held[i], words[i]))
    return [words[i] for i in order], held[order]


class Vocabulary:
    """The words that tasks hold, and classes of all words."""

    def __init__(self, words: list[bytes], classes: np.ndarray, settings: Settings):
        self.settings, self.classes = settings, classes
        self.place = {w: i for i, w in enumerate(words) if w != END}

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Class of each word and of the end; place of each word or -1; the words at -1."""
        words = text.lower().split()
        places = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        classes = np.append(self.classes[places] if len(self.classes) else np.zeros(len(words), np.int32), np.int32(self.settings.words))
        far = np.flatnonzero(places < 0)
        others = [words[i] for i in far.tolist()]
        if others:
            classes[far] = [bucket_of(w, self.settings) for w in others]
        return classes, places, others


PAIR_SCHEMA = "pair bigint, c bigint, word binary, contexts array<int>, counts array<bigint>"


def count_pairs(rows: DataFrame, vocabulary, settings: Settings, far: bool) -> DataFrame:
    """Pairs of a context and what follows; the context of a first word is the end.

    Rows with ``pair`` (context * classes + class) hold a part of its count
    ``c``. Rows with ``word``, a word outside the classes, hold a part of its
    counts by context; words that tasks do not hold only if ``far``.
    """
    size = settings.classes
    names = ["pair", "c", "word", "contexts", "counts"]

    def work(batches):
        cells = np.zeros(size * size, np.int64)
        words, of_words = vocabulary.value
        known = Vocabulary(words, of_words, settings)
        others: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        waiting = 0

        def emit() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            place, context = np.divmod(key, size)
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            more = list(others)
            of_row = [words[i] if i < len(words) else more[i - len(words)] for i in place[starts].tolist()]
            lengths = np.diff(np.r_[starts, len(key)])
            none = pa.nulls(len(starts), pa.int64())
            lists = [list_of(context.astype(np.int32), lengths, pa.int32()), list_of(count, lengths, pa.int64())]
            held.clear()
            others.clear()
            return pa.RecordBatch.from_arrays([none, none, pa.array(of_row, pa.binary()), *lists], names)

        for batch in slices(batches, "_text"):
            for text in utf8_parts(batch.column(0)):
                classes, places, unheld = known.encode(text)
                classes = classes.astype(np.int64)
                context = np.r_[settings.words, classes[:-1]]
                pair, count = np.unique(context * size + classes, return_counts=True)
                cells[pair] += count
                if far and unheld:
                    places[places < 0] = [len(words) + others.setdefault(w, len(others)) for w in unheld]
                own = np.flatnonzero((classes[:-1] > settings.words) & (places >= 0))
                if len(own):
                    held.append(places[own] * size + context[own])
                    waiting += len(own)
                if waiting > HELD_PAIRS or len(others) > HELD_WORDS:
                    yield emit()
                    waiting = 0
        if held:
            yield emit()
        pair = np.flatnonzero(cells)
        none = [pa.nulls(len(pair), t) for t in (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(cells[pair]), *none], names)

    return rows.select("_text").mapInArrow(work, PAIR_SCHEMA)


def inner_contexts(r: np.ndarray, pairs: np.ndarray, settings: Settings) -> np.ndarray:
    """What vectors of words see of each context: main directions of ``r``, of unit variance, and a constant."""
    share = pairs.sum(axis=1) + 1e-9
    share = share / share.sum()
    centred = r - share @ r
    _, size, directions = np.linalg.svd(centred * np.sqrt(share)[:, None], full_matrices=False)
    width = min(settings.inner_width, len(size))
    seen = centred @ directions[:width].T / np.maximum(size[:width], 1e-6)
    return np.c_[np.clip(seen, -6, 6), np.ones(len(r))].astype(np.float32)


def word_vectors(counted: np.ndarray, after: np.ndarray, share: np.ndarray, contexts: np.ndarray, settings: Settings) -> np.ndarray:
    """Vectors of a batch of words, by Newton steps on their noise-contrastive objectives.

    ``counted`` [word, context] are counts of a word after a context, ``after`` of
    its bucket after a context, ``share`` [word] is the word's share of its bucket.
    """
    width = contexts.shape[1]
    k = np.float32(settings.noise)
    drawn = k * share[:, None] * after
    both = counted + drawn
    upper = np.triu_indices(width)
    squares = np.ascontiguousarray(contexts[:, upper[0]] * contexts[:, upper[1]])
    curve = np.zeros((len(counted), width, width))
    q = np.zeros((len(counted), width), np.float32)
    penalty = settings.shrink * np.eye(width)
    for _ in range(settings.inner_steps):
        true = 1 / (1 + np.exp(np.clip(np.log(k) - q @ contexts.T, -30, 30)))
        slope = (counted - both * true) @ contexts - settings.shrink * q
        # Symmetric: both halves are set from one.
        curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = (both * (true - true * true)) @ squares
        step = np.linalg.solve(curve + penalty, slope[:, :, None].astype(np.float64))[:, :, 0]
        # Far from the optimum a full step may overshoot.
        step /= np.maximum(1.0, np.abs(step).max(axis=1, keepdims=True))
        q = np.clip(q + step, -4, 4).astype(np.float32)
    return q


VECTOR_SCHEMA = "word binary, c bigint, vector array<float>, bucket int, weights array<double>"


def train_words(parts: DataFrame, after: np.ndarray, contexts: np.ndarray, settings: Settings) -> DataFrame:
    """``word``, its count ``c`` and ``vector``, and per bucket parts of the ``weights`` of such words.

    ``weights`` holds their sum for each context and, last, the sum without
    context. All counts of a word come one after another to one task, which
    holds a batch of words.
    """
    shared = parts.sparkSession.sparkContext.broadcast((after.astype(np.float32), contexts))
    size, first = settings.classes, settings.words + 1
    names = ["word", "c", "vector", "bucket", "weights"]

    def work(batches):
        after, contexts = shared.value
        # Of all words of a bucket, with one more each as in the weights.
        totals = after.sum(axis=0) + 1.0
        sums = np.zeros((settings.buckets, size + 1))

        def learn(words: list[bytes], counted: np.ndarray) -> pa.RecordBatch:
            of_word = counted.sum(axis=1)
            bucket = np.array([bucket_of(w, settings) - first for w in words])
            share = (of_word / totals[bucket]).astype(np.float32)
            q = word_vectors(counted.astype(np.float32), after.T[bucket], share, contexts, settings)
            weight = (of_word + 1)[:, None]
            np.add.at(sums, bucket, np.c_[weight * np.exp((q @ contexts.T).astype(np.float64)), weight])
            vectors = list_of(q.ravel(), np.full(len(q), q.shape[1]), pa.float32())
            none = [pa.nulls(len(q), t) for t in (pa.int32(), pa.list_(pa.float64()))]
            c = pa.array(of_word.astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), c, vectors, *none], names)

        # The last word of a batch may go on in the next one; its counts by context wait.
        waiting, of_waiting = None, np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = batch.column(0).dictionary_encode()
            words = encoded.dictionary
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            at = np.repeat(encoded.indices.to_numpy(), lengths)
            context, n = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            extra = int(waiting is not None and waiting != words[0].as_py())
            earlier = np.flatnonzero(of_waiting)
            at = np.r_[np.zeros(len(earlier), np.int64), at + extra]
            context, n = np.r_[earlier, context], np.r_[of_waiting[earlier], n]
            last = len(words) - 1 + extra
            often = np.flatnonzero(np.bincount(at, weights=n, minlength=last + 1)[:last] >= settings.least)
            for start in range(0, len(often), WORD_BATCH):
                part = often[start : start + WORD_BATCH]
                row = np.full(last + 1, -1)
                row[part] = np.arange(len(part))
                here = row[at] >= 0
                cell = row[at[here]] * size + context[here]
                counted = np.bincount(cell, weights=n[here], minlength=len(part) * size).reshape(-1, size)
                yield learn([waiting if i < extra else words[int(i) - extra].as_py() for i in part], counted)
            waiting, ends = words[len(words) - 1].as_py(), at == last
            of_waiting = np.bincount(context[ends], weights=n[ends], minlength=size)
        if of_waiting.sum() >= max(1, settings.least):
            yield learn([waiting], of_waiting[None])
        used = np.flatnonzero(sums[:, -1])
        none = [pa.nulls(len(used), t) for t in (pa.binary(), pa.int64(), pa.list_(pa.float32()))]
        lists = list_of(sums[used].ravel(), np.full(len(used), size + 1), pa.float64())
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), lists], names)

    rows = parts.filter("word is not null").select("word", "contexts", "counts")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(work, VECTOR_SCHEMA)


def weights_of_buckets(trained: DataFrame, settings: Settings) -> np.ndarray:
    """Summed ``weights`` [bucket, context and total] of words with vectors; settings bound its size."""

    def work(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[bucket] = sums.get(bucket, 0.0) + part.values.to_numpy()
        if sums:
            width = settings.classes + 1
            lists = list_of(np.concatenate(list(sums.values())), np.full(len(sums), width), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists], ["bucket", "weights"])

    rows = trained.filter("bucket is not null").select("bucket", "weights").repartition("bucket")
    out = np.zeros((settings.buckets, settings.classes + 1))
    for row in bounded_rows(rows.mapInArrow(work, "bucket int, weights array<double>"), settings.buckets, "buckets of words"):
        out[row["bucket"]] = row["weights"]
    return out


def train(pairs: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probabilities [context, class] of the log-bilinear model, and its vectors of contexts.

    ``pairs`` are counts of the same shape. Before the first step the model is
    the noise distribution; Adam then follows the gradient of the expected
    noise-contrastive objective.
    """
    size, k = settings.classes, settings.noise
    total = max(1.0, float(pairs.sum()))
    noise = (pairs.sum(axis=0) + 1.0) / (total + size)
    seen = (pairs / total).astype(np.float32)
    drawn = (k * np.outer(seen.sum(axis=1), noise)).astype(np.float32)
    rng = np.random.default_rng(settings.seed)
    r = rng.normal(0, 0.1, (size, settings.width)).astype(np.float32)
    q = rng.normal(0, 0.1, (size, settings.width)).astype(np.float32)
    b = np.log(noise).astype(np.float32)
    against = np.log(k * noise).astype(np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (r, q, b)]
    for step in range(1, settings.steps + 1):
        true = 1 / (1 + np.exp(np.clip(against - (r @ q.T + b), -30, 30)))
        slope = seen * (1 - true) - drawn * true
        rate = settings.rate * (1 - (step - 1) / settings.steps) ** 0.5
        for x, g, (m, v) in zip((r, q, b), (slope @ q, slope.T @ r, slope.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    energy = (r @ q.T + b).astype(np.float64)
    top = energy.max(axis=1, keepdims=True)
    return energy - (top + np.log(np.exp(energy - top).sum(axis=1, keepdims=True))), r


def _score_parts(rows: DataFrame, kind: str, words, model, settings: Settings) -> DataFrame:
    """Per text: its numbers from what tasks hold, and its other words with their contexts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        logs, weights, of_buckets, vectors, contexts, scale, end_weight, end_known = model.value
        vocabulary = Vocabulary(*words.value, settings)
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "_text"):
            out, far, far_context = [], [], []
            for text in utf8_parts(batch.column(2)):
                classes, places, others = vocabulary.encode(text)
                held = places[places >= 0]
                base = weights[held].sum() + end_weight - len(classes) * scale
                before = np.r_[settings.words, classes[:-1]]
                inner = classes > settings.words
                score = logs[before, classes].sum()
                score -= of_buckets[classes[inner] - settings.words - 1, before[inner]].sum()
                own = np.flatnonzero(inner[:-1] & (places >= 0))
                score += weights[places[own]].sum()
                score += np.einsum("ij,ij->", vectors[places[own]], contexts[before[own]], dtype=np.float64) / np.log(10)
                far.extend(others)
                far_context.append(before[:-1][places < 0])
                known = len(held) + end_known
                out.append((number, len(classes), known, float(base), float(score)))
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            offsets = np.cumsum([0, *map(len, far_context)])
            pairs = [pa.array(far, pa.binary()), pa.array(np.concatenate(far_context).astype(np.int32))]
            words_of = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(pairs, ["word", "context"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays, words_of],
                ["_id", "held_out", "_row", "n_tokens", "_known", "_base", "_score", "_words"],
            )

    return rows.mapInArrow(
        work,
        f"_id {kind}, held_out boolean, _row bigint, n_tokens bigint, _known bigint, _base double, _score double,"
        " _words array<struct<word: binary, context: int>>",
    )


def _score_far(rows: DataFrame, contexts) -> DataFrame:
    """Per text: how many of its other words are known, the logs of their counts and of their fit to the contexts."""

    def work(batches):
        table = contexts.value.astype(np.float64)
        for batch in batches:
            vector = batch.column(3)
            fit = np.zeros(batch.num_rows)
            with_vector = np.flatnonzero(vector.is_valid().to_numpy(zero_copy_only=False))
            if len(with_vector):
                q = vector.flatten().to_numpy().reshape(len(with_vector), -1)
                at = batch.column(1).to_numpy()[with_vector]
                fit[with_vector] = (q * table[at]).sum(axis=1) / np.log(10)
            log = np.log10(batch.column(2).to_numpy() + 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log), pa.array(fit)], ["_row", "log", "fit"])

    scored = rows.select("_row", "context", "c", "vector").mapInArrow(work, "_row bigint, log double, fit double")
    return scored.groupBy("_row").agg(F.count(F.lit(1)).alias("_far"), F.sum("log").alias("_log"), F.sum("fit").alias("_fit"))


def score_texts(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", settings: Settings | None = None
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id has the remainder 2 (crc32 of the id as text, modulo 7) are
    held out; the model learns from all others. Scores are base-10 logarithms
    of the probability of the whole text with its end, ``base_score`` under
    smoothed word frequencies. Null texts are empty: just the end. Null ids are
    trained on. Rows with equal ids are scored each on its own; an empty table
    gives no rows; other columns are not read.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("_id"), _held_out(id_column).alias("held_out"), F.col(text_column).alias("_text")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    training = rows.filter("not held_out")
    counts = cut_lineage(count_words(training))
    size = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.coalesce(F.max(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    words, weights = frequent_words(counts, settings.known_words)
    classes = classes_of(words, settings)
    held = spark.sparkContext.broadcast((words, classes))
    # Words that tasks do not hold are no more frequent than the last held one.
    rarest = int(weights[-1]) if len(weights) else settings.least
    found = cut_lineage(count_pairs(training, held, settings, far=rarest >= settings.least))
    # At most classes x classes cells.
    cells = found.filter("pair is not null").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros((settings.classes, settings.classes))
    pairs.ravel()[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    logs, r = train(pairs, settings)
    logs /= np.log(10)
    contexts = inner_contexts(r, pairs, settings)
    trained = cut_lineage(train_words(found, pairs[:, settings.words + 1 :], contexts, settings))
    with_vectors = trained.filter("word is not null").select("word", "c", "vector")
    # No more words than ``known_words`` have such counts.
    near = with_vectors.filter(F.col("c") >= rarest).select("word", "vector").toArrow()
    place = {w: i for i, w in enumerate(words)}
    vectors = np.zeros((max(1, len(words)), contexts.shape[1]), np.float32)
    found_places = [place.get(w, -1) for w in near.column(0).to_pylist()]
    values = near.column(1).combine_chunks()
    for i, at in enumerate(found_places):
        if at >= 0:
            vectors[at] = values[i].values.to_numpy()

    tail = F.expr("substring(word, greatest(length(word) - 2, 1), 3)")
    bucket = F.pmod(F.crc32(tail), F.lit(settings.buckets))
    by_bucket = bounded_rows(
        counts.groupBy(bucket.alias("k")).agg(F.sum(F.col("c") + 1).alias("t")), settings.buckets, "buckets of words"
    )
    # One more in each bucket for all words never seen; none for the words that are classes of their own.
    of_buckets = np.ones(settings.buckets)
    for r in by_bucket:
        of_buckets[r["k"]] += r["t"]
    for i in np.flatnonzero(classes <= settings.words).tolist():
        of_buckets[bucket_of(words[i], settings) - settings.words - 1] -= weights[i] + 1
    sums = weights_of_buckets(trained, settings)
    of_pairs = np.log10((of_buckets - sums[:, -1])[:, None] + sums[:, :-1])
    ends = size["ends"]
    scale = float(np.log10(size["n"] + size["v"] + 1))
    model = spark.sparkContext.broadcast(
        (logs, np.log10(weights + 1.0), of_pairs, vectors, contexts, scale, float(np.log10(ends + 1)), int(ends > 0))
    )
    parts = cut_lineage(_score_parts(rows, kind, held, model, settings))
    far = parts.select("_row", F.explode("_words").alias("_w")).select("_row", "_w.word", "_w.context")
    joined = far.join(counts, "word").join(with_vectors.select("word", "vector"), "word", "left")
    more = _score_far(joined, spark.sparkContext.broadcast(contexts))
    zero = F.coalesce("_log", F.lit(0.0))
    return parts.join(more, "_row", "left").select(
        F.col("_id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_far", F.lit(0))).alias("n_known"),
        F.lit(size["n"]).cast("bigint").alias("train_tokens"),
        (F.col("_base") + zero).alias("base_score"),
        (F.col("_score") + zero + F.coalesce("_fit", F.lit(0.0))).alias("score"),
    )
