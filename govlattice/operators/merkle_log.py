"""Merkle logs that grow: stored peaks, so an append hashes only what is new.

A log of n leaves is a range of perfect trees, one for each bit of n: its
peaks. They are stored with the number of leaves, at most 64 rows a log. An
append climbs from the new leaves in blocks of ``2**bits`` nodes and takes the
peaks on the way in; blocks are exchanged by (log, block), never a whole log.
The root is folded from the peaks alone and is the same as that of the whole
tree of :mod:`~govlattice.operators.merkle`, where the last node of an odd level
is paired with itself. Hashes are stored and shuffled as bytes. Finished nodes never change, so proofs of any age read
stored nodes and the right edge that follows from the peaks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.operators.merkle import BLOCK_BITS, STEP_TYPE, hash_pair
from govlattice.session import cut_lineage

# Heights that 64-bit positions can have.
HEIGHTS = 63
NODE = "struct<height:int,at:bigint,hash:string>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _packed(hash_: Column) -> Column:
    """A hash as it is stored and shuffled: its bytes where it is hexadecimal in small letters, else its text."""
    raw = F.unhex(hash_)
    same = F.coalesce(F.lower(F.hex(raw)) == hash_, F.lit(False))
    return F.struct(F.when(same, raw).alias("raw"), F.when(~same, hash_).alias("text"))


def _plain(packed: Column) -> Column:
    return F.coalesce(F.lower(F.hex(packed["raw"])), packed["text"])


def _nodes_packed(climbed: Column) -> Column:
    made = F.transform(climbed["made"], lambda n: F.struct(n["height"], n["at"], _packed(n["hash"]).alias("hash")))
    return F.struct(climbed["at"], climbed["nodes"], made.alias("made"), climbed["peaks"])


def _climb(level: Column, bits: int, base: int) -> Column:
    """Fold one block upwards: ``nodes`` left at its top, finished ``made`` nodes, ``peaks`` that found no partner.

    ``level`` has ``at`` and ``hashes`` of the lowest level and ``old``: peaks of
    the log by height, which stand left of the block's first node.
    """
    empty = F.array().cast(f"array<{NODE}>")

    def step(acc: Column, k: Column) -> Column:
        own = F.get(F.filter(level["old"], lambda p: p["height"] == base + k), F.lit(0))
        return _bound(own, lambda own: taken(acc, k, own))

    def taken(acc: Column, k: Column, own: Column) -> Column:
        joins = own.isNotNull() & (F.size(acc["nodes"]) > 0)
        nodes = F.when(joins, F.concat(F.array(own["hash"]), acc["nodes"])).otherwise(acc["nodes"])
        at = F.when(joins, acc["at"] - 1).otherwise(acc["at"])
        return _bound(F.struct(nodes.alias("nodes"), at.alias("at"), joins.alias("joins")), lambda row: paired(acc, k, own, row))

    def paired(acc: Column, k: Column, own: Column, row: Column) -> Column:
        nodes = row["nodes"]
        whole = F.floor(F.size(nodes) / 2).cast("int")
        up = F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: i < whole),
            lambda i: hash_pair(F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)),
        )
        return _bound(up, lambda up: folded(acc, k, own, row, up))

    def folded(acc: Column, k: Column, own: Column, row: Column, up: Column) -> Column:
        nodes, at, joins = row["nodes"], row["at"], row["joins"]
        above = F.floor(at / 2).cast("bigint")
        made = F.transform(
            up,
            lambda h, i: F.struct((base + k + 1).cast("int").alias("height"), (above + i).alias("at"), h.alias("hash")),
        )
        # An odd last node waits for its partner; so does an old peak that no new node came to.
        last = F.struct(
            (base + k).cast("int").alias("height"),
            (at + F.size(nodes) - 1).cast("bigint").alias("at"),
            F.element_at(nodes, -1).alias("hash"),
        )
        waits = F.when((F.size(nodes) % 2) == 1, F.array(last)).when(
            own.isNotNull() & ~joins, F.array(own.cast(NODE))
        ).otherwise(empty)
        return F.struct(
            above.alias("at"),
            up.alias("nodes"),
            F.concat(acc["made"], made.cast(f"array<{NODE}>")).alias("made"),
            F.concat(acc["peaks"], waits.cast(f"array<{NODE}>")).alias("peaks"),
        )

    start = F.struct(
        level["at"].cast("bigint").alias("at"),
        level["hashes"].alias("nodes"),
        empty.alias("made"),
        empty.alias("peaks"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step)


def append_leaves(
    peaks: DataFrame | None, leaves: DataFrame, keys: list[str], pos: str = "pos", hash_: str = "hash", bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """(nodes, peaks): the nodes an append finishes, leaves included, and the peaks after it.

    ``peaks``: keys, leaves, height, at, hash, as returned by the append before
    (None: a new log). ``leaves`` holds each log's new leaves; ``pos`` goes on
    from its number of leaves without gaps. Logs without new leaves keep their
    peaks. Null keys are a log of their own.
    """
    names = [F.col(k) for k in keys]
    new = leaves.select(*names, F.col(pos).cast("bigint").alias("at"), F.col(hash_).alias("hash"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema.fields[: len(keys)])
    if peaks is None:
        peaks = leaves.sparkSession.createDataFrame([], f"{kind}, leaves bigint, height int, at bigint, hash string")
    old = cut_lineage(peaks.select(*keys, "height", "at", "hash", "leaves"))
    level = new
    finished, waiting = [], []
    base, reach, most = 0, 1, 0
    while base == 0 or reach < most:
        blocks = level.select(*keys, "at", _packed(F.col("hash")).alias("hash")).groupBy(
            *keys, F.shiftright("at", bits).alias("_block")
        ).agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("_items"))
        # The peaks of these heights stand in the block that the log's next node falls into.
        here = old.filter((F.col("height") >= base) & (F.col("height") < base + bits)).groupBy(
            *keys, F.shiftright(F.shiftright("leaves", base), bits).alias("_block")
        ).agg(F.collect_list(F.struct("height", "at", "hash")).alias("_old"))
        left, right = blocks.alias("l"), here.alias("r")
        same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_block")])
        joined = left.join(right, same, "full").select(
            *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in (*keys, "_block")], "l._items", "r._old"
        )
        block = F.struct(
            F.coalesce(F.get("_items", F.lit(0))["at"], F.lit(0)).alias("at"),
            F.coalesce(F.transform("_items", lambda x: _plain(x["hash"])), F.array().cast("array<string>")).alias("hashes"),
            F.coalesce("_old", F.array().cast(f"array<{NODE}>")).alias("old"),
        )
        # The leaves of a block are stored along with its nodes: the append's only copy of them.
        own = [F.col("_items").alias("_own"), (F.element_at("_items", -1)["at"] + 1).alias("_end")] if base == 0 else []
        climbed = cut_lineage(
            joined.withColumn("_b", block).select(
                *keys, "_block", *own, _bound(_climb(F.col("_b"), bits, base), _nodes_packed).alias("_c")
            )
        )
        if base == 0:
            finished.append(
                climbed.select(*keys, F.explode("_own").alias("_n")).select(
                    *keys, F.lit(0).alias("height"), "_n.at", _plain(F.col("_n.hash")).alias("hash")
                )
            )
            grown = climbed.filter("_end IS NOT NULL").groupBy(*keys).agg(F.max("_end").alias("leaves"))
            most = grown.agg(F.max("leaves").alias("m")).first()["m"] or 0
        finished.append(
            climbed.select(*keys, F.explode("_c.made").alias("_n")).select(
                *keys, "_n.height", "_n.at", _plain(F.col("_n.hash")).alias("hash")
            )
        )
        waiting.append(climbed.select(*keys, F.explode("_c.peaks").alias("_n")).select(*keys, "_n.*"))
        level = climbed.filter(F.size("_c.nodes") > 0).select(
            *keys, F.col("_block").alias("at"), F.get("_c.nodes", F.lit(0)).alias("hash")
        )
        base, reach = base + bits, reach << bits
    # What came out of the last block, and peaks above all blocks.
    waiting.append(level.select(*keys, F.lit(base).cast("int").alias("height"), "at", "hash"))
    waiting.append(old.filter(F.col("height") >= base).select(*keys, "height", "at", "hash"))
    before = old.groupBy(*keys).agg(F.max("leaves").alias("leaves"))
    sizes = grown.unionByName(before).groupBy(*keys).agg(F.max("leaves").alias("_leaves"))
    rows = reduce(DataFrame.unionByName, waiting).alias("p").join(
        sizes.alias("s"), reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    )
    after = rows.select(*[F.col(f"p.{k}") for k in keys], F.col("_leaves").alias("leaves"), "height", "at", "hash")
    # The nodes are read from the blocks as they are stored; only the few peaks are written anew.
    return reduce(DataFrame.unionByName, finished), cut_lineage(after)


def right_edges(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """The unfinished nodes of each log: keys, leaves, height, at, hash; the highest is the root if n is no power of two."""
    held = peaks.groupBy(*keys, "leaves").agg(F.collect_list(F.struct("height", "hash")).alias("_p"))
    empty = F.array().cast(f"array<{NODE}>")

    def step(acc: Column, k: Column) -> Column:
        own = F.get(F.filter(F.col("_p"), lambda p: p["height"] == k), F.lit(0))["hash"]
        left = F.coalesce(own, acc["hash"])
        up = F.when(left.isNotNull(), hash_pair(left, F.coalesce(acc["hash"], left)))
        at = F.call_function("shiftright", F.col("leaves"), k + 1)
        # Above the only peak of a full tree, and above the root, there is nothing.
        top = (at == 0) & (acc["hash"].isNull() | own.isNull())
        node = F.struct((k + 1).cast("int").alias("height"), at.alias("at"), up.alias("hash"))
        return F.when(top | up.isNull(), acc).otherwise(
            F.struct(up.alias("hash"), F.concat(acc["out"], F.array(node).cast(f"array<{NODE}>")).alias("out"))
        )

    start = F.struct(F.lit(None).cast("string").alias("hash"), empty.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(HEIGHTS - 1)), start, step, lambda a: a["out"])
    return held.select(*keys, "leaves", F.explode(walked).alias("_n")).select(*keys, "leaves", "_n.*")


def log_roots(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, root and number of leaves of each log, from its peaks."""
    nodes = peaks.unionByName(right_edges(peaks, keys))
    return nodes.groupBy(*keys, "leaves").agg(F.max(F.struct("height", "hash"))["hash"].alias("root"))


def _siblings(levels: Column, block: Column, base: int, at: Column, leaves: Column, bits: int) -> Column:
    """Steps of a node at height ``base`` up to the top of its block.

    ``levels`` are the block's nodes by height, each level in order without gaps.
    """

    def step(k: Column) -> Column:
        own = F.call_function("shiftright", at, k)
        even = own % 2 == 0
        other = F.when(even, own + 1).otherwise(own - 1)
        # A node whose partner lies behind the end is paired with itself.
        wanted = F.when(F.call_function("shiftleft", other, k + base) >= leaves, own).otherwise(other)
        first = F.call_function("shiftleft", block, F.lit(bits) - k)
        node = F.get(F.get(levels, k), (wanted - first).cast("int"))
        return F.struct(
            (node["at"] == wanted).alias("stored"),
            node["hash"].alias("sibling_hash"),
            F.when(even, "right").otherwise("left").alias("position"),
        )

    # As many steps lead to the root as a tree of the log's size has levels.
    heights = F.ceil(F.log2(leaves)).cast("int")
    steps = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: k + base < heights)
    # A node without a hash is a step all the same.
    stored = F.filter(F.transform(steps, step), lambda s: s["stored"])
    return F.transform(stored, lambda s: F.struct(s["sibling_hash"], s["position"])).cast(STEP_TYPE)


def _blocks_of(nodes: DataFrame, keys: list[str], base: int, bits: int) -> DataFrame:
    """``levels`` of the blocks whose lowest nodes have height ``base``; of nodes in one place the last by ``_now`` counts."""
    here = nodes.filter((F.col("height") >= base) & (F.col("height") < base + bits)).select(
        *keys, (F.col("height") - base).alias("_k"), "at", "_now", _packed(F.col("hash")).alias("hash")
    )
    blocks = here.groupBy(*keys, F.expr(f"shiftright(at, {bits} - _k)").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_k", "at", "_now", "hash"))).alias("_all")
    )

    def is_last(n: Column, i: Column) -> Column:
        after = F.get(F.col("_all"), i + 1)
        return after.isNull() | (after["_k"] != n["_k"]) | (after["at"] != n["at"])

    def levels(nodes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.filter(nodes, lambda n: n["_k"] == k))

    last = F.transform(
        F.filter("_all", is_last), lambda n: F.struct(n["_k"].alias("_k"), n["at"].alias("at"), _plain(n["hash"]).alias("hash"))
    )
    return blocks.select(*keys, "_block", _bound(last, levels).alias("levels"))


def log_proofs(
    nodes: DataFrame,
    peaks: DataFrame,
    leaves: DataFrame,
    keys: list[str],
    pos: str = "pos",
    bits: int = BLOCK_BITS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Inclusion path and root of each of ``leaves`` (keys, pos) in the log as its peaks have it.

    ``nodes`` are the finished nodes of all appends so far; a node beyond the
    size that the peaks record is not used, so older peaks still give proofs.
    Nodes and leaves meet in blocks of ``bits`` heights, as in an append: each
    is shuffled once, the path above a block is found once for all its leaves,
    and no path is shuffled. Columns of ``leaves`` named in ``keep`` are passed on.
    """
    # A finished node of a later append covers leaves that these peaks do not have: the edge stands there.
    edge = right_edges(peaks, keys).select(*keys, "height", "at", "hash", F.lit(1).alias("_now"))
    every = nodes.select(*keys, "height", "at", "hash", F.lit(0).alias("_now")).unionByName(edge)
    most = peaks.agg(F.max("leaves").alias("m")).first()["m"] or 0
    bases = [0]
    while 1 << (bases[-1] + bits) < most:
        bases.append(bases[-1] + bits)
    none = F.array().cast(STEP_TYPE)
    above = log_roots(peaks, keys).select(*keys, F.lit(0).cast("bigint").alias("_block"), none.alias("_above"), "leaves", "root")
    on = [*keys, "_block"]
    for base in reversed(bases[1:]):
        # The nodes at this height are the blocks below.
        size = F.ceil(F.col("leaves") / F.lit(float(1 << base))).cast("bigint")
        first = F.expr(f"shiftleft(_block, {bits})")
        below = F.sequence(first, F.least(first + (1 << bits), size) - 1)
        rows = above.join(_blocks_of(every, keys, base, bits), on, "left")
        paths = F.transform(
            below,
            lambda at: F.struct(
                at.alias("_block"),
                F.concat(
                    F.coalesce(_siblings(F.col("levels"), F.col("_block"), base, at, F.col("leaves"), bits), none), F.col("_above")
                ).alias("_above"),
            ),
        )
        above = rows.select(*keys, F.explode(paths).alias("_b"), "leaves", "root").select(*keys, "_b.*", "leaves", "root")
    asked = leaves.select(*keys, F.col(pos).cast("bigint").alias("pos"), *keep)
    asked = asked.groupBy(*keys, F.shiftright("pos", bits).alias("_block")).agg(F.collect_list(F.struct("pos", *keep)).alias("_asked"))
    rows = asked.join(above, on).join(_blocks_of(every, keys, 0, bits), on, "left")
    # Logs of one leaf have an empty path.
    proofs = F.transform(
        F.filter("_asked", lambda a: a["pos"] < F.col("leaves")),
        lambda a: F.struct(
            *[a[c].alias(c) for c in ("pos", *keep)],
            F.concat(
                F.coalesce(_siblings(F.col("levels"), F.col("_block"), 0, a["pos"], F.col("leaves"), bits), none), F.col("_above")
            ).alias("path"),
        ),
    )
    out = rows.select(*keys, F.explode(proofs).alias("_p"), "leaves", "root")
    return out.select(*keys, "_p.pos", *[F.col(f"_p.{c}") for c in keep], "leaves", "root", "_p.path")
