"""Best-fit packing of token sequences, planned on the histogram of their lengths.

Where a piece goes depends only on its length and on its rank among the pieces
of that length. So best-fit decreasing is run over counts, on the driver, over
at most ``capacity`` numbers however large the corpus is; the pieces then take
the planned places by a join on length and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlattice.llm.common import fresh_folder, list_of, slices, utf8_parts
from govlattice.llm.tokens import SLICE_BYTES, word_encoder
from govlattice.session import bounded_rows

PLAN = T.StructType(
    [
        T.StructField(n, T.LongType(), False)
        for n in ("_length", "_from", "_to", "_sequence", "_each", "_place")
    ]
)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Runs (length, first rank, end rank, first sequence, pieces per sequence, first offset).

    Longest first, each piece into the fullest sequence that still holds it,
    for all pieces of a length at once: equally full sequences are kept as
    ranges, and a length fills one range after the other. Each length splits at
    most one range, so the plan has a size that ``capacity`` bounds.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first, how many)
    rooms: list[int] = []
    runs: list[tuple[int, ...]] = []
    made = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room, first, many = capacity, made, -(-left // (capacity // length))
                made += many
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if rest:
                runs.append((length, rank, rank + rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                rank += rest
                left -= rest
                full += 1
            put(room, first + full, many - full)
    return runs


def token_pieces(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end: int = 1,
    capacity: int = 4096,
) -> DataFrame:
    """Write the pieces of every whole text: at most ``capacity`` ids each, only longer documents are cut.

    Columns: the id, ``piece``, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32``, ``tokens``, and ``_part`` and ``_rank``, which
    number the pieces of a length within a task. Ranks are fixed by writing.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches):
        from pyspark import TaskContext

        words, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)  # at most one entry for each length
        for batch in slices(batches, "_text", SLICE_BYTES):
            ids, sizes = words.encode(list(utf8_parts(batch.column(1))), end)
            cuts = -(-sizes // capacity)
            rows_of = np.repeat(np.arange(len(sizes)), cuts)
            pieces = np.arange(len(rows_of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            lengths = np.minimum(sizes[rows_of] - pieces * capacity, capacity)
            raw, ends = ids.astype("<i4", copy=False).view(np.uint8), np.cumsum(lengths) * 4
            sums = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            ranks = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths.tolist()):
                ranks[i] = seen[n]
                seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_of)),
                    pa.array(pieces.astype(np.int32)),
                    pa.array(pieces * capacity),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                    list_of(ids, lengths, pa.int32()),
                    pa.array(np.full(len(lengths), part, np.int32)),
                    pa.array(ranks),
                ],
                ["_id", "piece", "start", "length", "ids_crc32", "tokens", "_part", "_rank"],
            )

    out = rows.mapInArrow(
        work,
        f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, tokens array<int>,"
        " _part int, _rank bigint",
    ).withColumnRenamed("_id", id_column)
    out.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces.

    ``pieces`` has ``length``, ``_part`` and ``_rank`` as :func:`token_pieces`
    writes them; they are dropped. Lengths must lie between 1 and ``capacity``.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    counts = bounded_rows(
        pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity, "lengths of pieces"
    )
    runs = best_fit_plan({r["length"]: r["n"] for r in counts}, capacity)
    plan = F.broadcast(spark.createDataFrame(runs, PLAN))  # bounded by the capacity, not by the input
    ranked = pieces.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return (
        ranked.join(plan, on)
        .withColumn("sequence_id", F.col("_sequence") + F.expr("(_rank - _from) div _each"))
        .withColumn("offset", F.col("_place") + F.pmod(nth, F.col("_each")) * F.col("length"))
        .drop("_part", "_rank", "_base", *PLAN.names)
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end: int = 1,
    capacity: int = 4096,
    tokens: bool = False,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    Returns a row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and, if asked for, ``tokens``. The pieces of a
    sequence follow each other without gaps from offset 0.

    Null and empty texts are one piece with the end id. Equal ids and repeated
    rows are packed each on its own. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    folder = fresh_folder(docs.sparkSession, "pieces")
    pieces = token_pieces(
        docs, folder, tokenizer, id_column=id_column, text_column=text_column, end=end, capacity=capacity
    )
    placed = place_pieces(pieces if tokens else pieces.drop("tokens"), capacity)
    names = [id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*names, *(["tokens"] if tokens else []))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids, from :func:`pack_documents` with tokens.

    A sequence holds at most as many ids as the capacity, so the lists are bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("tokens"))
