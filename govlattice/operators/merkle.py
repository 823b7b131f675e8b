"""Merkle trees over ordered hashes: roots, inclusion proofs, checkpoints.

A tree is reduced in blocks of ``2**bits`` consecutive nodes. One shuffle
brings a block together and reduces it by ``bits`` levels in one array
expression, so a tree of a billion leaves takes three shuffles instead of
thirty, and no task ever holds more than one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.operators.audit import seal

EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256("")
BLOCK_BITS = 10
STEP_TYPE = "array<struct<sibling_hash:string,position:string>>"


def hash_pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, right), 256)


def _next_level(nodes: Column) -> Column:
    """Pairwise hashes; the last node of an odd level is paired with itself."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(
        pairs,
        lambda i: hash_pair(
            F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2))
        ),
    )


def _levels(nodes: Column, whole: Column, bits: int) -> Column:
    """All levels of a block, bottom first.

    A block that is the whole tree stops at one node. A block of a larger tree
    always climbs ``bits`` levels: its last node is duplicated exactly where
    the full level has an odd number of nodes, since all earlier blocks are
    even at every level.
    """

    def climb(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        done = whole & (F.size(top) == 1)
        return F.when(done, levels).otherwise(F.concat(levels, F.array(_next_level(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.array(nodes), climb)


def _path(levels: Column, at: Column) -> Column:
    """Sibling and side per level for the node at position ``at`` of a block."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def sibling(nodes: Column, level: Column) -> Column:
        idx = F.floor(at / F.pow(F.lit(2.0), level)).cast("int")
        even = idx % 2 == 0
        other = F.when(even, idx + 1).otherwise(idx - 1)
        return F.struct(
            F.coalesce(F.get(nodes, other), F.get(nodes, idx)).alias("sibling_hash"),
            F.when(even, "right").otherwise("left").alias("position"),
        )

    return F.transform(below, sibling).cast(STEP_TYPE)


def _block_level(nodes: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Reduce nodes (keys, pos, hash, n) by one block level, keeping the levels."""
    size = 1 << bits
    blocks = nodes.groupBy(*keys, F.floor(F.col("pos") / size).cast("bigint").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("_items"),
        F.first("n").alias("n"),
    )
    hashes = F.transform("_items", lambda x: x["hash"])
    return blocks.withColumn("_leaves", hashes).withColumn(
        "levels", _levels(F.col("_leaves"), F.col("n") <= size, bits)
    )


def _rounds(leaves: DataFrame, keys: list[str], bits: int, max_leaves: int | None) -> int:
    if max_leaves is None:
        row = leaves.agg(F.max("n").alias("m")).collect()[0]
        max_leaves = row["m"] or 1
    return max(1, math.ceil(math.log2(max(2, max_leaves)) / bits))


def _sized(leaves: DataFrame, keys: list[str], pos: str, hash_: str) -> DataFrame:
    base = leaves.select(*keys, F.col(pos).cast("bigint").alias("pos"), F.col(hash_).alias("hash"))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return base.join(sizes, keys)


def merkle_roots(
    leaves: DataFrame,
    keys: list[str],
    pos: str = "pos",
    hash_: str = "hash",
    bits: int = BLOCK_BITS,
    max_leaves: int | None = None,
) -> DataFrame:
    """Root and number of leaves per tree. ``pos`` is dense from 0 in each tree.

    Without ``max_leaves`` the size of the largest tree is looked up first to
    know the number of rounds.
    """
    nodes = _sized(leaves, keys, pos, hash_)
    total = nodes.select(*keys, "n").groupBy(*keys).agg(F.first("n").alias("leaves"))
    for _ in range(_rounds(nodes, keys, bits, max_leaves)):
        nodes = _climb(_block_level(nodes, keys, bits), keys, bits)
    return nodes.select(*keys, F.col("hash").alias("root")).join(total, keys)


def _climb(blocks: DataFrame, keys: list[str], bits: int) -> DataFrame:
    size = 1 << bits
    return blocks.select(
        *keys,
        F.col("block").alias("pos"),
        F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"),
        F.ceil(F.col("n") / size).cast("bigint").alias("n"),
    )


def merkle_proofs(
    leaves: DataFrame,
    keys: list[str],
    pos: str = "pos",
    hash_: str = "hash",
    bits: int = BLOCK_BITS,
    max_leaves: int | None = None,
) -> DataFrame:
    """Root and inclusion path of every leaf of every tree in one job."""
    nodes = _sized(leaves, keys, pos, hash_)
    rounds = _rounds(nodes, keys, bits, max_leaves)
    out: DataFrame | None = None
    for r in range(rounds):
        blocks = _block_level(nodes, keys, bits)
        here = blocks.select(
            *keys, "block", "levels", F.posexplode("_items").alias("_at", "_x")
        ).select(
            *keys,
            F.col("block").alias("_up"),
            F.col("_x.pos").alias("pos"),
            F.col("_x.hash").alias("hash"),
            _path(F.col("levels"), F.col("_at")).alias("path"),
            F.get(F.element_at("levels", -1), F.lit(0)).alias("root"),
        )
        if out is None:
            out = here
        else:
            upper = here.select(
                *keys,
                F.col("pos").alias("_up"),
                F.col("_up").alias("_next"),
                F.col("path").alias("_more"),
                F.col("root").alias("_top"),
            )
            out = out.join(upper, [*keys, "_up"]).select(
                *keys,
                F.col("_next").alias("_up"),
                "pos",
                "hash",
                F.concat("path", "_more").alias("path"),
                F.col("_top").alias("root"),
            )
        if r < rounds - 1:
            nodes = _climb(blocks, keys, bits)
    return out.drop("_up")


def fold_path(leaf: Column, path: Column) -> Column:
    """Hash reached by climbing a proof path from a leaf."""
    return F.aggregate(
        path,
        leaf,
        lambda acc, s: F.when(s["position"] == "right", hash_pair(acc, s["sibling_hash"])).otherwise(
            hash_pair(s["sibling_hash"], acc)
        ),
    )


def verify_proofs(proofs: DataFrame, leaf: str = "hash", path: str = "path", root: str = "root"):
    return proofs.withColumn("valid", fold_path(F.col(leaf), F.col(path)) == F.col(root))


def create_checkpoints(
    sealed: DataFrame,
    chain: str,
    seq: str,
    batch_rows: int = 256,
    since: DataFrame | None = None,
    segment_rows: int = 1_024,
    created_at: Column | None = None,
) -> DataFrame:
    """Chained checkpoints over batches of ``batch_rows`` events.

    ``since`` holds (chain, range_end) of what is already covered: only later
    events are read. The checkpoint number is the batch number, so repeated
    runs agree; the hash chain over the checkpoints is sealed like events.
    """
    if batch_rows > 1 << BLOCK_BITS:
        raise ValueError(f"a batch has at most {1 << BLOCK_BITS} events")
    events = sealed
    if since is not None:
        done = since.select(chain, F.col("range_end").alias("_end"))
        events = sealed.join(done, chain, "left").filter(
            F.col("_end").isNull() | (F.col(seq) >= F.col("_end"))
        )
    leaves = events.select(
        chain,
        F.floor(F.col(seq) / batch_rows).cast("bigint").alias("batch"),
        F.col(seq).alias("_seq"),
        "hash",
    )
    batches = leaves.groupBy(chain, "batch").agg(
        F.sort_array(F.collect_list(F.struct("_seq", "hash"))).alias("_items")
    )
    hashes = F.transform("_items", lambda x: x["hash"])
    at = F.lit("") if created_at is None else created_at.cast("string")
    rows = (
        batches.withColumn("_leaves", hashes)
        .withColumn("_levels", _levels(F.col("_leaves"), F.lit(True), BLOCK_BITS))
        .select(
            chain,
            "batch",
            F.concat(F.col(chain).cast("string"), F.lit(":"), F.col("batch")).alias(
                "checkpoint_id"
            ),
            F.get("_items", F.lit(0))["_seq"].alias("range_start"),
            (F.element_at("_items", -1)["_seq"] + 1).alias("range_end"),
            F.size("_items").cast("bigint").alias("event_count"),
            F.get(F.element_at("_levels", -1), F.lit(0)).alias("merkle_root"),
            at.alias("created_at"),
        )
    )
    return seal(rows, chain, "batch", checkpoint_body(), segment_rows)


def checkpoint_body() -> Column:
    """The hashed text of a checkpoint row, for sealing and verifying."""
    names = ("checkpoint_id", "created_at", "range_start", "range_end", "merkle_root")
    return F.concat(*[F.col(c).cast("string") for c in names])


def event_proofs(
    sealed: DataFrame, checkpoints: DataFrame, chain: str, seq: str, batch_rows: int = 256
) -> DataFrame:
    """Proof of every covered event against the root its checkpoint recorded.

    Events find their checkpoint by the batch number, an equality, instead of a
    search over ranges.
    """
    leaves = sealed.select(
        chain,
        F.floor(F.col(seq) / batch_rows).cast("bigint").alias("batch"),
        F.pmod(F.col(seq), F.lit(batch_rows)).alias("_at"),
        "hash",
    )
    proofs = merkle_proofs(leaves, [chain, "batch"], "_at", "hash", max_leaves=batch_rows)
    recorded = checkpoints.select(chain, "batch", "checkpoint_id", "merkle_root")
    return proofs.join(recorded, [chain, "batch"]).select(
        chain,
        "checkpoint_id",
        F.col("hash").alias("event_hash"),
        (F.col("batch") * batch_rows + F.col("pos")).alias(seq),
        "merkle_root",
        "path",
        (fold_path(F.col("hash"), F.col("path")) == F.col("merkle_root")).alias("valid"),
    )


def attach_checkpoints(
    events: DataFrame, checkpoints: DataFrame, chain: str, seq: str, width: int
) -> DataFrame:
    """Events with the checkpoint whose [range_start, range_end) holds them.

    For checkpoints of uneven size: each range is spread over the fixed-width
    slots it touches, events look only at their own slot.
    """
    slots = checkpoints.withColumn(
        "_slot",
        F.explode(
            F.sequence(
                F.floor(F.col("range_start") / width), F.floor((F.col("range_end") - 1) / width)
            )
        ),
    ).select(chain, "_slot", "checkpoint_id", "range_start", "range_end")
    keyed = events.withColumn("_slot", F.floor(F.col(seq) / width))
    return (
        keyed.join(slots, [chain, "_slot"])
        .filter((F.col(seq) >= F.col("range_start")) & (F.col(seq) < F.col("range_end")))
        .drop("_slot")
    )
