"""Strong phrases of two and three words, grown best-first under score bounds.

A phrase can occur no more often than its prefix, so the counts of a prefix
bound the score of all that grows from it: a phrase with first word v that
begins with the pair p scores at most f(p) / f(v), by its cut after v. Pairs
are the frontier. They are taken in falling order of that bound, down to a
level that follows from the scores of the pairs themselves; only phrases of
three words that begin with a taken pair - or end with a pair in contention,
since they may cover it - are ever counted. Once a language's surviving phrases
at or above its level number as many as are wanted, nothing that is left on the
frontier can reach them or tie with them; else the level is lowered.

Tasks test words and pairs against a bit map of the frontier. Its size is
fixed, and a false hit only has one more phrase counted, exactly as all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlattice.llm.common import broadcast_if_small, slices, utf8_parts
from govlattice.session import cut_lineage

# Bits of the map; 16 for each entry as long as that is fewer.
MOST_BITS = 1 << 26
SLICE = 3 << 20
PIECE_END, BLANK = 10, 32
MILLION = Decimal(1_000_000)
# What an entry of the map says of a pair, or of a word.
WORD, FREQUENT, TAKEN, CONTESTED = 1, 2, 3, 4


def _byte_table() -> np.ndarray:
    """A-Z lower-cased, ends of pieces and blanks each as one byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = PIECE_END
    table[9] = BLANK
    return table


def cut_words(data: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words in order, the distinct words, and whether each word's successor is in its piece."""
    inside = (data != PIECE_END) & (data != BLANK)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    stops = np.flatnonzero(data == PIECE_END)
    piece = np.searchsorted(stops, starts)
    follows = np.r_[piece[1:] == piece[:-1], False][: len(starts)]
    return coded.indices.to_numpy(), coded.dictionary, follows


def _chunks(texts: list[bytes], table: np.ndarray) -> Iterator[np.ndarray]:
    """The texts as mapped bytes, cut at ends of pieces about every ``SLICE`` bytes."""
    data = table[np.frombuffer(b"\n".join(texts), np.uint8)]
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data):
            stops = np.flatnonzero(data[at:end] == PIECE_END)
            if len(stops):
                end = at + int(stops[-1]) + 1
                break
            end += SLICE
        yield data[at:end]
        at = end


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(first: np.ndarray, second: np.ndarray | int, tag: int) -> np.ndarray:
    out = first * np.uint64(0x9E3779B97F4A7C15) + np.asarray(second, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * tag)
    return out ^ (out >> np.uint64(32))


class BitMap:
    """Entries (a word or a pair of words, and a tag) as one bit each."""

    def __init__(self, bits: int, data: np.ndarray):
        self.mask, self.data = np.uint64(bits - 1), data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def build_map(entries: DataFrame) -> tuple[int, np.ndarray]:
    """The map of ``lang``, ``u``, ``v`` (null: a word), ``tag``: bits are set in groups of 32,768 by Spark."""
    bits = 1 << 16
    wanted = 16 * entries.count()
    while bits < min(wanted, MOST_BITS):
        bits <<= 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            out = []
            for (lang, tag), rows in frame.groupby(["lang", "tag"]):
                u = _hashes([w.encode() for w in rows["u"]], lang)
                v = _hashes([w.encode() for w in rows["v"]], lang) if tag != WORD else 0
                out.append(_mixed(u, v, int(tag)) & np.uint64(bits - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64))], ["p"])

    found = entries.select("lang", "u", "v", "tag").mapInArrow(places, "p bigint")
    group = F.floor(F.col("p") / 32768)
    parts = found.groupBy(group.alias("g")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("b")).toArrow()
    data = np.zeros(bits // 8, np.uint8)
    for g, b in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        data[g * 4096 : (g + 1) * 4096] = np.frombuffer(b, np.uint8)[: bits // 8]
    return bits, data


def _joined(words: pa.Array, *codes: np.ndarray) -> list[pa.Array]:
    return [words.take(pa.array(c)).cast(pa.string()) for c in codes]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _of_chunk(data: np.ndarray, size: int, lang: str, bitmap: BitMap | None) -> list[pa.Array] | None:
    """Distinct phrases of ``size`` words of a chunk that the map admits: one array per word, and the counts."""
    codes, words, follows = cut_words(data)
    many = len(words)
    if size == 1 or not many:
        return [words.cast(pa.string()), pa.array(np.bincount(codes, minlength=many))] if many else None
    hashes = _hashes(words.to_pylist(), lang)
    known = bitmap.has(_mixed(hashes, 0, WORD)) if size == 2 else np.ones(many, bool)
    at = np.flatnonzero(follows)
    first, second = codes[at].astype(np.int64), codes[at + 1].astype(np.int64)
    if size == 2:
        good = known[first] & known[second]
        keys, counts = _counted(first[good] * many + second[good])
        return [*_joined(words, keys // many, keys % many), pa.array(counts)]
    pairs, back = np.unique(first * many + second, return_inverse=True)
    u, v = hashes[pairs // many], hashes[pairs % many]
    tags = [bitmap.has(_mixed(u, v, tag)) for tag in (FREQUENT, TAKEN, CONTESTED)]
    number = np.full(len(codes), -1)
    number[at] = back
    one = at[np.isin(at + 1, at, assume_unique=True)]
    p, q = number[one], number[one + 1]
    good = tags[0][p] & tags[0][q] & (tags[1][p] | tags[2][q])
    keys, counts = _counted(p[good].astype(np.int64) * many + codes[one[good] + 2])
    head = pairs[keys // many]
    return [*_joined(words, head // many, head % many, keys % many), pa.array(counts)]


def _count(rows: DataFrame, size: int, held=None) -> DataFrame:
    """``lang``, ``w1`` ... , ``c``: how often each phrase that the map admits occurs, over all texts."""
    names = [f"w{k}" for k in range(1, size + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_table()
        bitmap = BitMap(*held.value) if held is not None else None
        for batch in slices(batches, "_text", SLICE):
            langs = batch.column(0).to_pylist()
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, utf8_parts(batch.column(1))):
                texts.setdefault(lang, []).append(text)
            for lang, group in texts.items():
                for data in _chunks(group, table):
                    arrays = _of_chunk(data, size, lang, bitmap)
                    if arrays and len(arrays[0]):
                        where = pa.array([lang]).take(pa.array(np.zeros(len(arrays[0]), np.int32)))
                        yield pa.RecordBatch.from_arrays([where, *arrays], ["lang", *names, "c"])

    words = ", ".join(f"{n} string" for n in names)
    parts = rows.mapInArrow(work, f"lang string, {words}, c bigint")
    return parts.groupBy("lang", *names).agg(F.sum("c").alias("c"))


def _score(a: str, left: str, right: str) -> Column:
    whole = {c: f"cast({c} as decimal(15,0))" for c in (a, left, right)}
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({whole[a]} * {whole[a]})) div ({whole[left]} * {whole[right]})")


def _top(df: DataFrame, most: int) -> DataFrame:
    """The first rows of each language; Spark cuts them before the shuffle, so no language is gathered whole."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return df.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)


class _Search:
    def __init__(self, rows: DataFrame, least: int, share: int, top: int):
        self.rows, self.least, self.share, self.top = rows, least, share, top
        self.spark = rows.sparkSession
        counts = cut_lineage(_count(rows, 1))
        self.totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
        self.words = counts.filter(F.col("c") >= least)
        self.pairs = cut_lineage(self._scored_pairs())
        self.triples: DataFrame | None = None

    def _broadcast_map(self, entries: DataFrame):
        return self.spark.sparkContext.broadcast(build_map(entries))

    def _scored_pairs(self) -> DataFrame:
        entries = self.words.select("lang", F.col("w1").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(WORD).alias("tag"))
        held = self._broadcast_map(entries)
        pairs = cut_lineage(_count(self.rows, 2, held).filter(F.col("c") >= self.least))
        left = self.words.select("lang", "w1", F.col("c").alias("l"))
        right = self.words.select("lang", F.col("w1").alias("w2"), F.col("c").alias("r"))
        joined = pairs.withColumnRenamed("c", "a").join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
        bound = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0))) div cast(l as decimal(15,0))")
        phrase = F.concat_ws(" ", "w1", "w2").alias("phrase")
        return joined.select("lang", "w1", "w2", phrase, "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound"))

    def levels(self, rank: int) -> DataFrame:
        """``lang``, ``level``: the score of its pair of that rank, or 0 if there are fewer."""
        found = _top(self.pairs.select("lang", "phrase", "a", "score"), rank).filter(F.col("rank") == rank)
        return self.totals.select("lang").join(found.select("lang", F.col("score").alias("level")), "lang", "left").select(
            "lang", F.coalesce("level", F.lit(0).cast("bigint")).alias("level")
        )

    def grow(self, levels: DataFrame) -> None:
        """Count the phrases of three words from pairs between ``level`` and ``before`` (null: no upper end)."""
        near = self.pairs.join(broadcast_if_small(levels), "lang")

        def fresh(value: str) -> Column:
            return (F.col(value) >= F.col("level")) & (F.col("before").isNull() | (F.col(value) < F.col("before")))

        tags = F.array_compact(
            F.array(
                F.lit(FREQUENT), F.when(fresh("bound"), F.lit(TAKEN)), F.when(fresh("score"), F.lit(CONTESTED))
            )
        )
        entries = near.select("lang", F.col("w1").alias("u"), F.col("w2").alias("v"), F.explode(tags).alias("tag"))
        held = self._broadcast_map(entries)
        found = _count(self.rows, 3, held).filter(F.col("c") >= self.least).withColumnRenamed("c", "a")
        one = self.words.select("lang", F.col("w1").alias("w3"), F.col("c").alias("f3"))
        head = self.pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
        tail = self.pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
        joined = cut_lineage(found).join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(one, ["lang", "w3"])
        scored = joined.withColumns({"early": _score("a", "f1", "f23"), "late": _score("a", "f12", "f3")})
        first = F.col("early") <= F.col("late")
        triples = cut_lineage(
            scored.select(
                "lang", "w1", "w2", "w3", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
                F.least("early", "late").alias("score"),
            )
        )
        # A phrase found from both of its pairs has the same numbers each time.
        self.triples = triples if self.triples is None else cut_lineage(self.triples.union(triples).distinct())

    def survivors(self, levels: DataFrame) -> DataFrame:
        """Phrases at or above their language's level that no longer candidate covers."""
        ends = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
        cover = self.triples.select("lang", "a", ends.alias("p")).groupBy("lang", "p.w1", "p.w2")
        cover = cover.agg(F.max("a").alias("most"))
        level = broadcast_if_small(levels.select("lang", "level"))
        pairs = self.pairs.join(level, "lang").filter("score >= level").join(cover, ["lang", "w1", "w2"], "left")
        left = pairs.filter(F.col("most").isNull() | (100 * F.col("most") < self.share * F.col("a")))
        names = ["lang", "phrase", "a", "l", "r", "score"]
        return left.select(*names).unionByName(self.triples.join(level, "lang").filter("score >= level").select(*names))


def collocations(
    docs: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    least: int = 10,
    share: int = 50,
    top: int = 2_000,
    reach: int = 2,
) -> DataFrame:
    """The ``top`` strongest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at ``.,;:!?`` and line ends, pieces into words
    at blanks and tabs; A-Z are lower-cased. Phrases are two or three words of a
    piece that occur ``least`` times in their language. A phrase scores one
    million times the square of its count ``a`` over the product of the counts
    ``l`` and ``r`` of its two parts, rounded down, at its weakest cut (ties: the
    earlier). Pairs with ``share`` percent of their occurrences or more inside
    one phrase of three are dropped. Ties in score go by count, then by phrase.
    Null languages are ``und``; null texts are empty. Repeated rows count each
    time. Languages without a phrase, and empty tables, have no rows. Other
    columns are not read. The first level takes the pairs down to the score of
    rank ``reach * top``; each further one four times as many.
    """
    lang, text = F.coalesce(F.col(lang_column), F.lit("und")), F.coalesce(F.col(text_column), F.lit(""))
    search = _Search(docs.select(lang.alias("lang"), text.alias("_text")), least, share, top)
    rank = reach * top
    levels = cut_lineage(search.levels(rank).withColumn("before", F.lit(None).cast("bigint")))
    while True:
        search.grow(levels)
        found = cut_lineage(_top(search.survivors(levels), top))
        settled = found.filter(F.col("rank") == top).select("lang")
        open_ = cut_lineage(levels.filter("level > 0").join(settled, "lang", "left_anti"))
        if open_.isEmpty():
            break
        rank *= 4
        lower = search.levels(rank).withColumnRenamed("level", "next").join(open_.select("lang"), "lang")
        # Levels always fall: below a long run of ties they go on with the next score.
        step = F.least("next", F.col("level") - 1)
        levels = cut_lineage(
            levels.join(lower, "lang", "left").select(
                "lang", F.coalesce(step, F.col("level")).alias("level"), F.col("level").alias("before")
            )
        )
    return found.join(broadcast_if_small(search.totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
