"""Removal of byte strings that start more than once in a corpus, with suffix arrays.

A string of ``least`` bytes has one anchor: the smallest hash among its grams of
``GRAM`` bytes, the last of equal ones. Equal strings have equal anchors, so
the starts of a text fall into runs that share an anchor, and only runs with
the same anchor hash can hold equal strings. Runs whose bytes are equal too are
settled by counting. One copy of each of the different ones goes to the suffix
arrays: their bytes are sorted in two stages - suffixes smaller than their
successors directly, all others induced from them by one scan over the buckets
of first bytes - and neighbours that share ``least`` bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.llm.common import per_process, slices, utf8_parts
from govlattice.session import cut_lineage

GRAM = 100
# Starts looked at in one vectorised step.
STEP = 1 << 20
# Bytes that one suffix array sorts; a group of runs is never cut.
ARRAY_BYTES = 48 << 10
# Different runs with one anchor hash, beyond which their strings are counted instead.
MOST_RUNS = 2_000
# Not a byte of UTF-8.
BETWEEN = b"\xff"
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the longest table so far is kept for later texts."""
    held = per_process("powers", dict)
    if len(held.get("both", ((),))[0]) < size:
        held["both"] = _new_powers(size)
    return held["both"]


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    both = []
    for x in (base, inverse):
        out = np.full(size, x, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return tuple(both)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(32))


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from running minima inside blocks of the width in both directions."""
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    many = len(values) - width + 1
    return np.minimum(back[:many], forth[width - 1 : width - 1 + many])


def anchored_runs(text: bytes, least: int = 400) -> tuple[np.ndarray, ...]:
    """Runs of starts: anchor hash, hash of the run's bytes, first start, number of starts."""
    many = len(text) - least + 1
    found = []
    width = least - GRAM + 1
    for at in range(0, many, STEP):
        here = min(STEP, many - at)
        part = np.frombuffer(text, np.uint8, here + least - 1, at).astype(np.uint64)
        size = 1 << max(16, int(len(part)).bit_length())
        power, inverse = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * power[: len(part)], out=total[1:])
        grams = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[: len(total) - GRAM])
        anchor = _window_minimum(grams, width)
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (grams[width:] == anchor[1:])]
        first = np.flatnonzero(fresh)
        length = np.diff(np.r_[first, here])
        whole = _mixed((total[first + length + least - 1] - total[first]) * inverse[first])
        found.append((anchor[first], whole, first + at, length))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(head)[1:] - 1, len(starts) - 1]
    return starts[head], reach[last]


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successors. Stage
    two scans the buckets from the smallest first byte on: when a suffix is
    reached, the one before it, if larger than its successor, takes the next
    place at the front of its own bucket. A bucket is handled as a whole, since
    what it induces lies in later buckets or behind itself.
    """
    codes = np.frombuffer(text, np.uint8)
    size = len(codes)
    if not size:
        return np.zeros(0, np.int64)
    step = np.r_[np.sign(np.diff(codes.astype(np.int16))), -1]  # the end is smaller than anything
    # A suffix compares to its successor as the next two unequal bytes do.
    at = np.where(step != 0, np.arange(size), size - 1)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    chosen = np.flatnonzero(small).tolist()
    direct = np.array(sorted(chosen, key=lambda i: text[i : i + depth]), np.int64)
    bounds = np.searchsorted(codes[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[codes[-1]].append(np.array([size - 1]))
    out = []

    def induce(suffixes: np.ndarray, byte: int) -> np.ndarray:
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        first = codes[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        same = before[:0]
        for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
            if first[lo] == byte:
                same = before[lo:hi]
            else:
                waiting[first[lo]].append(before[lo:hi])
        return same

    for byte in np.unique(codes).tolist():
        rest = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(rest):
            out.append(rest)
            rest = induce(rest, byte)
        if len(own := direct[bounds[byte] : bounds[byte + 1]]):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out)


def repeated_starts(parts: list[bytes], starts: list[int], least: int) -> list[np.ndarray]:
    """For each part the starts (of its first ``starts[i]``) whose ``least`` bytes start elsewhere in the parts too."""
    text = BETWEEN.join(parts) + BETWEEN
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])[:-1]
    valid = np.zeros(len(text), bool)
    for b, n in zip(begins, starts):
        valid[b : b + n] = True
    order = suffix_array(text, least)
    order = order[valid[order]]
    # Adjacent common prefixes: only whether they reach ``least`` matters.
    windows = [text[i : i + least] for i in order.tolist()]
    equal = np.fromiter((a == b for a, b in zip(windows, windows[1:])), bool, max(0, len(windows) - 1))
    hit = np.zeros(len(text), bool)
    hit[order[np.r_[equal, False] | np.r_[False, equal]]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins, starts)]


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    return starts[head], starts[np.r_[head[1:] - 1, len(starts) - 1]] + 1


def _find_runs(rows: DataFrame, kind: str, least: int) -> DataFrame:
    """All runs of all texts; ``known`` marks ranges of starts that repeat within their own text."""

    def of_text(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        if len(text) < least:
            return
        anchor, whole, first, many = anchored_runs(text, least)
        head, back = np.arange(len(anchor)), None
        if len(np.unique(anchor ^ whole)) < len(anchor):
            _, head, back = np.unique(np.stack([anchor, whole]), axis=1, return_index=True, return_inverse=True)
        yield anchor[head].view(np.int64), whole[head].view(np.int64), first[head], many[head], np.zeros(len(head), bool)
        if back is not None:
            twice = (np.bincount(back.ravel()) > 1)[back.ravel()]
            lo, hi = merged(first[twice], (first + many)[twice])
            zero = np.zeros(len(lo), np.int64)
            yield zero, zero, lo, hi - lo, np.ones(len(lo), bool)

    def work(batches):
        for batch in slices(batches, "_text"):
            parts, rows_of = [], []
            for i, text in enumerate(utf8_parts(batch.column(2))):
                for part in of_text(text):
                    parts.append(part)
                    rows_of.append(np.full(len(part[0]), i))
            if parts:
                at = pa.array(np.concatenate(rows_of))
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *columns],
                    ["_id", "_k", "m", "h", "lo", "n", "known"],
                )

    return rows.mapInArrow(work, f"_id {kind}, _k bigint, m bigint, h bigint, lo bigint, n bigint, known boolean")


def _segments(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The bytes of the wanted runs (``_id``, ``_k``, ``m``, ``h``, ``n``, ``lo``, ``many``)."""
    per_text = wanted.groupBy("_id", "_k").agg(F.collect_list(F.struct("m", "h", "n", "lo", "many")).alias("_runs"))
    both = rows.join(per_text.withColumnsRenamed({"_id": "_id2", "_k": "_k2"}), _same_row()).select("_text", "_runs")

    def work(batches):
        for batch in slices(batches, "_text", 1 << 20):
            out = []
            for text, runs in zip(utf8_parts(batch.column(0)), batch.column(1)):
                out += [(r["m"], r["h"], r["n"], r["many"], text[r["lo"] : r["lo"] + r["n"] + least - 1]) for r in runs.as_py()]
            if out:
                kinds = [pa.int64()] * 4 + [pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["m", "h", "n", "many", "part"])

    return both.mapInArrow(work, "m bigint, h bigint, n bigint, many bigint, part binary")


def _same_row() -> Column:
    return F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_k") == F.col("_k2"))


def _sorted_repeats(segments: DataFrame, least: int) -> DataFrame:
    """Repeated starts of runs by suffix arrays over groups with one anchor hash: m, h, n, a, b."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({(m, h, n): (m, h, n, part) for m, h, n, part in rows}.values())
        found = []
        for (m, h, n, _), hits in zip(rows, repeated_starts([r[3] for r in rows], [r[2] for r in rows], least)):
            if len(hits):
                found += [(m, h, n, a, b) for a, b in zip(*(x.tolist() for x in _ranges(hits)))]
        if found:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], list("mhnab"))
        return None

    def work(batches):
        held: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != group and size >= ARRAY_BYTES:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                group = row[0]
                held.append(row)
                size += len(row[3])
        if held and (out := solve(held)) is not None:
            yield out

    dealt = segments.select("m", "h", "n", "part").repartition("m").sortWithinPartitions("m")
    return dealt.mapInArrow(work, "m bigint, h bigint, n bigint, a bigint, b bigint")


def _counted_repeats(segments: DataFrame, least: int) -> DataFrame:
    """The same for anchors with very many different runs: their strings are counted by a hash of 128 bits."""

    def work(batches):
        from hashlib import blake2b

        for batch in slices(batches, "part", 1 << 16):
            out = []
            for m, h, n, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out += [(m, h, n, a, blake2b(part[a : a + least], digest_size=16).digest()) for a in range(n)]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["m", "h", "n", "a", "w"])

    starts = segments.select("m", "h", "n", "part").dropDuplicates(["m", "h", "n"]).mapInArrow(
        work, "m bigint, h bigint, n bigint, a bigint, w binary"
    )
    twice = starts.groupBy("m", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m", "w")
    hits = starts.join(twice, ["m", "w"], "left_semi")
    return hits.select("m", "h", "n", "a", (F.col("a") + 1).alias("b"))


def _cut(rows: DataFrame, least: int, as_text: bool) -> DataFrame:
    """Texts with ``_ranges`` of repeated starts to ``n_bytes``, ``spans`` and ``kept``."""
    before = rows.schema["_row"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, "_text"):
            sizes, spans, kept = [], [], []
            for text, ranges in zip(utf8_parts(batch.column(1)), batch.column(2).to_pylist()):
                gone = []
                if ranges:
                    pairs = np.array([(r["a"], r["b"]) for r in ranges], np.int64)
                    lo, hi = merged(pairs[:, 0], pairs[:, 1] + least - 1)
                    gone = list(zip(lo.tolist(), hi.tolist()))
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *[x for pair in gone for x in pair], len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_row", "n_bytes", "spans", "kept"])

    out = rows.select("_row", "_text", "_ranges").mapInArrow(
        work,
        f"_row {before}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>,"
        f" kept {'string' if as_text else 'binary'}",
    )
    return out.select("_row.*", "n_bytes", "spans", "kept")


def remove_repeats(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = 400,
    most_runs: int = MOST_RUNS,
    carry: Sequence[str] = (),
    as_text: bool = False,
) -> DataFrame:
    """One row per document: id, carried columns, ``n_bytes``, removed ``spans`` and the ``kept`` bytes.

    Texts are UTF-8 bytes. Each byte that a string of ``least`` bytes covers
    which also starts anywhere else, in the same document too, is removed.
    Overlaps count; strings are judged on the input. Matches never cross
    documents. Null and empty texts have no bytes. Rows with equal ids are
    documents of their own, so repeated rows remove each other (from ``least``
    bytes on). An empty table gives no rows; other columns are not read.
    """
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_k"),
        F.col(text_column).alias("_text"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    runs = cut_lineage(_find_runs(rows, kind, least))
    fresh = runs.filter("not known")
    groups = fresh.groupBy("m", "h", "n").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("_id", "_k", "lo")).alias("rep")
    )
    per_anchor = groups.groupBy("m").agg(F.count(F.lit(1)).alias("many"), F.sum("c").alias("all")).filter("all > 1")
    groups = cut_lineage(groups.join(per_anchor, "m").select("m", "h", "n", "c", "many", "rep.*"))
    segments = cut_lineage(_segments(rows, groups.filter("many > 1"), least))
    few = F.col("many") <= most_runs
    marks = (
        groups.filter("c > 1")
        .select("m", "h", "n", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))
        .unionByName(_sorted_repeats(segments.filter(few), least))
        .unionByName(_counted_repeats(segments.filter(~few), least))
    )
    marked = fresh.join(marks, ["m", "h", "n"]).select(
        "_id", "_k", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")
    )
    known = runs.filter("known").select("_id", "_k", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    per_text = marked.unionByName(known).groupBy("_id", "_k").agg(F.collect_set(F.struct("a", "b")).alias("_ranges"))
    whole = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_column, *carry])]).alias("_row")
    texts = docs.select(
        F.col(id_column).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_k"),
        F.col(text_column).alias("_text"),
        whole,
    )
    joined = texts.join(per_text.withColumnsRenamed({"_id": "_id2", "_k": "_k2"}), _same_row(), "left")
    return _cut(joined, least, as_text)
