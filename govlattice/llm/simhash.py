"""SimHash near-duplicates, found with BK-trees over shards of fingerprints.

Fingerprints that differ in at most r bits agree on one of r + 1 blocks of
their bits, so the values of each block deal the distinct fingerprints into
shards. A shard becomes a BK-tree: the children of a node are keyed by their
Hamming distance to it, and a search with radius r follows only the edges
within r of its own distance. Shards beyond a set size are split into several
trees, and each is probed by the parts of the shard in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.llm.common import slices, utf8_parts, whole
from govlattice.llm.components import connected_components
from govlattice.session import cut_lineage

# Fingerprints of one tree; a larger shard is split.
TREE_SIZE = 8_192
# Rows of the trees that a task builds and searches at once.
FOREST_ROWS = 200_000
# Pairs (query, node) looked at in one vectorised step.
STEP_PAIRS = 4_000_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of a text in bytes; 0 for a text without words."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    many = max(1, len(words) - shingle + 1)
    lasts = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter(
        (digest(joined[i:j], seed) for i, j in zip(begins[:many].tolist(), lasts.tolist())), np.uint64, many
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, many, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > many).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_column: str, name: str, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Replace the text by its fingerprint, a long with the same 64 bits."""
    kept = [c for c in docs.columns if c != text_column]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]

    def work(batches):
        for batch in slices(batches, text_column):
            texts = utf8_parts(batch.column(batch.schema.get_field_index(text_column)))
            prints = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, batch.num_rows)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(prints.view(np.int64))], [*kept, name])

    return docs.select(*kept, text_column).mapInArrow(work, ", ".join([*fields, f"`{name}` bigint"]))


class Forest:
    """BK-trees over the fingerprints of several groups, one tree for each.

    All trees are built together, a level at a time: of the fingerprints that
    arrive at a node with equal distance the first becomes the child, the
    others go on from there.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.group, self.prints = group, prints
        order = np.argsort(group, kind="stable")
        first = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
        self.roots = order[first]
        self.root_group = group[self.roots]
        at = np.repeat(self.roots, np.diff(np.r_[np.flatnonzero(first), len(order)]))
        rest, node = order[~first], at[~first]
        edges = []  # (parent * 65 + distance, child)
        while len(rest):
            key = node * 65 + np.bitwise_count(prints[rest] ^ prints[node])
            by = np.argsort(key, kind="stable")
            key, rest = key[by], rest[by]
            head = np.r_[True, key[1:] != key[:-1]]
            edges.append((key[head], rest[head]))
            node = np.repeat(rest[head], np.diff(np.r_[np.flatnonzero(head), len(rest)]))
            rest, node = rest[~head], node[~head]
        keys = np.concatenate([k for k, _ in edges]) if edges else np.zeros(0, np.int64)
        children = np.concatenate([c for _, c in edges]) if edges else np.zeros(0, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[by], children[by]

    def near(self, group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position of the query, position in the tree of its group) within the radius."""
        at = np.searchsorted(self.root_group, group)
        has = (at < len(self.roots)) & (self.root_group[np.minimum(at, len(self.roots) - 1)] == group)
        query = np.flatnonzero(has)
        stack = [(query, self.roots[at[query]])]
        while stack:
            query, node = stack.pop()
            if len(query) > STEP_PAIRS:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            apart = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            close = apart <= radius
            if close.any():
                yield query[close], node[close]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(apart + radius, 64), "right")
            many = high - low
            total = int(many.sum())
            if total:
                starts = np.cumsum(many) - many
                index = np.arange(total) - np.repeat(starts - low, many)
                stack.append((np.repeat(query, many), self.children[index]))


def _spanning(query: np.ndarray, found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the pairs: each node and the smallest position it reaches."""
    root = np.arange(size)
    while True:
        a, b = root[query], root[found]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    node = np.flatnonzero(root != np.arange(size))
    return node, root[node]


def _links_of(group: np.ndarray, prints: np.ndarray, role: np.ndarray, radius: int):
    """Links of one task: role 0 stands in the tree and probes it, 1 stands in it only, 2 probes only."""
    tree = np.flatnonzero(role < 2)
    probe = np.flatnonzero(role != 1)
    if not len(tree) or not len(probe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forest = Forest(group[tree], prints[tree])
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q, n in forest.near(group[probe], prints[probe], radius):
        keep = prints[probe[q]] != prints[tree[n]]
        # Only what still joins components is kept, so memory follows the rows, not the pairs.
        left, right = _spanning(
            np.r_[left, probe[q[keep]]], np.r_[right, tree[n[keep]]], len(group)
        )
    return left, right


def shard_links(prints: DataFrame, radius: int = 4, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``f`` within ``radius`` bits.

    The links of a shard are a spanning forest of its pairs: no component is
    lost and their number follows that of the fingerprints.
    """
    blocks = radius + 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = [
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("f", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
        )
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    dealt = prints.select("f", F.explode(F.array(*keys)).alias("k")).select("f", "k.*")
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = dealt.join(sizes, ["block", "value"])
    trees = F.ceil(F.col("_n") / tree_size).cast("bigint")
    # Cell (t, u) of a shard: tree t, probed by part u. Every pair of parts meets in one cell.
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("f"), trees)).select(
        "f", "block", "value", "_own", F.explode(F.sequence(F.lit(0).cast("bigint"), trees - 1)).alias("_other")
    )
    rows = rows.select(
        F.xxhash64("block", "value", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_shard"),
        "f",
        F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).alias("_role"),
    )
    # Cells that share a hash become one: that adds candidates, never links.
    spread = rows.repartition("_shard").sortWithinPartitions("_shard")

    def work(batches):
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush(final: bool):
            nonlocal held, count
            shard, f, role = (np.concatenate(x) for x in zip(*held))
            # The last shard may go on in the next batch.
            end = len(shard) if final else int(np.searchsorted(shard, shard[-1]))
            held, count = ([(shard[end:], f[end:], role[end:])], len(shard) - end) if end < len(shard) else ([], 0)
            if end:
                group = np.cumsum(np.r_[0, (shard[1:end] != shard[: end - 1]).astype(np.int64)])
                a, b = _links_of(group, f[:end].view(np.uint64), role[:end], radius)
                yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], ["a", "b"])

        for batch in batches:
            held.append(tuple(np.asarray(batch.column(i)) for i in range(3)))
            count += batch.num_rows
            if count >= FOREST_ROWS:
                yield from flush(False)
        if count:
            yield from flush(True)

    return spread.mapInArrow(work, "a bigint, b bigint").distinct()


def _with_components(docs: DataFrame, id_column: str, text_column: str, shingle: int, radius: int, seed: int):
    """(prints, parts): ``_id``, ``_k`` (hash of the text), ``f`` of every row; ``f`` and component ``c`` of each fingerprint."""
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_k"),
        F.col(text_column).alias("_text"),
    )
    prints = cut_lineage(with_fingerprint(rows, "_text", "f", shingle, seed))
    distinct = cut_lineage(prints.select("f").distinct())
    found = connected_components(shard_links(distinct, radius)).withColumnsRenamed({"node": "f", "component": "c"})
    return prints, distinct.join(found, "f", "left").withColumn("c", F.coalesce("c", "f"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id that can be reached over links, the
    document's own included. Null, empty and blank texts have the fingerprint
    zero and are linked like any other. Documents with equal ids stay rows of
    their own; a null id is never the smallest unless all are null. An empty
    table gives no rows; other columns are not read.
    """
    prints, parts = _with_components(docs, id_column, text_column, shingle, radius, seed)
    least = prints.groupBy("f").agg(F.min("_id").alias("_least")).join(parts, "f")
    least = cut_lineage(least)
    ids = least.groupBy("c").agg(F.min("_least").alias("component_id"))
    of_print = least.select("f", "c").join(ids, "c").select("f", "component_id")
    return prints.join(of_print, "f").select(
        F.col("_id").alias(id_column),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_of_each(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
) -> DataFrame:
    """The rows of :func:`near_duplicates` with the smallest id of each group, all columns kept.

    Among equal ids the smallest text hash stays, null ids come last, and rows
    equal in id and text count as one.
    """
    prints, parts = _with_components(docs, id_column, text_column, shingle, radius, seed)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_k"))
    least = prints.groupBy("f").agg(F.min(order).alias("_first"))
    chosen = least.join(parts, "f").groupBy("c").agg(F.min("_first").alias("_first"))
    chosen = chosen.select(F.col("_first._id").alias("_id"), F.col("_first._k").alias("_k"))
    rows = docs.select(
        whole(docs).alias("_whole"),
        F.col(id_column).alias("_own_id"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_own_k"),
    )
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_k") == F.col("_k"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["_own_id", "_own_k"]).select("_whole.*")
