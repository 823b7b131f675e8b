"""Hash-chained audit events: sealing, verification, traces, tail.

An event belongs to a chain and has a dense position ``seq`` in it. Every event
carries the hash of the one before it. A chain may be sealed in segments of a
fixed number of rows, so that many tasks share one chain: the first segment
starts from the genesis hash, each other one from a hash of the chain's key and
the segment's number (:func:`segment_start`), so a segment is valid in its own
place only. The heads of the segments form a chain of their own
(:func:`segment_heads`), and :func:`verify_heads` compares them with heads kept
elsewhere. A chain that fits into one segment is the plain linear chain, and
``segment_rows=None`` seals a linear chain of any length. The streaming sealer
writes the same hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import with_neighbours

GENESIS = "0" * 64
SEGMENT_ROWS = 1_024


def event_body(*parts: Column, separator: str = "") -> Column:
    """Text that is hashed after the previous hash.

    A separator that cannot occur in the fields keeps text from moving between
    neighbouring fields unseen; without one the fields are simply joined.
    """
    out: list[Column] = []
    for i, p in enumerate(parts):
        if separator and i:
            out.append(F.lit(separator))
        out.append(p.cast("string"))
    return F.concat(*out)


def chain_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, body), 256)


def canonical_json(pairs: dict[str, Column]) -> Column:
    """JSON text with sorted keys, fixed once and hashed verbatim."""
    return F.to_json(F.struct(*[pairs[k].alias(k) for k in sorted(pairs)]))


def utc_text(at: Column) -> Column:
    """A time as events carry it."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def segment_start(chain: Column, segment: Column) -> Column:
    """Hash that a segment starts from; the genesis hash for the first one."""
    place = F.concat_ws("\x1f", F.lit(GENESIS), chain.cast("string"), segment.cast("string"))
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(F.sha2(place, 256))


def seal(
    events: DataFrame,
    chain: str,
    seq: str,
    body: Column,
    segment_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``segment``, ``prev_hash`` and ``hash``.

    Rows are dealt out by segment and hashed in order as they pass by, so
    nothing is gathered, whatever the length of a segment. With
    ``segment_rows=None`` a chain is one segment: the linear chain, in which
    every event carries the hash of the one before and which only one task can
    hash. Bodies are put together behind the shuffle, which moves events only.
    """
    segment = F.floor(F.col(seq) / segment_rows).cast("bigint") if segment_rows else F.lit(0).cast("bigint")
    keyed = events.withColumns({"_chain": F.col(chain).cast("string"), "_segment": segment})
    rows = keyed.repartition("_chain", "_segment").sortWithinPartitions("_chain", "_segment", F.col(seq))
    dealt = rows.select(
        F.struct(*events.columns).alias("_row"),
        "_chain",
        F.col("_segment").alias("segment"),
        segment_start(F.col("_chain"), F.col("_segment")).alias("_start"),
        body.alias("_body"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, prev = None, ""
        for batch in batches:
            before, after = [], []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_chain", "segment", "_start", "_body")]
            for key, part, start, text in zip(*columns):
                if (key, part) != place:
                    place, prev = (key, part), start
                before.append(prev)
                # A null body cannot be hashed, and neither can what follows it.
                prev = None if text is None or prev is None else hashlib.sha256((prev + text).encode()).hexdigest()
                after.append(prev)
            arrays = [batch.column(0), batch.column(2), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "segment", "prev_hash", "hash"])

    kind = dealt.schema["_row"].dataType.simpleString()
    out = dealt.mapInArrow(work, f"_row {kind}, segment bigint, prev_hash string, hash string")
    return out.select("_row.*", "segment", "prev_hash", "hash")


def segment_heads(sealed: DataFrame, chain: str, seq: str) -> DataFrame:
    """One row per segment: its last hash and size, ready to be sealed again."""
    return sealed.groupBy(chain, "segment").agg(
        F.max_by("hash", seq).alias("head"), F.count(F.lit(1)).alias("n")
    )


def seal_heads(
    sealed: DataFrame, chain: str, seq: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """The chain over the segment heads; apply again while it has many segments."""
    heads = segment_heads(sealed, chain, seq).withColumnRenamed("segment", "part")
    return seal(
        heads, chain, "part", event_body(F.col("head"), F.col("n"), separator="\x1f"), segment_rows
    )


def verify_heads(sealed: DataFrame, stored: DataFrame, chain: str, seq: str) -> DataFrame:
    """Segments whose head or size differs from what was stored: chain, segment, finding.

    ``stored`` holds rows of :func:`segment_heads` kept where the events' writer
    cannot change them. Findings: ``missing``, ``unknown``, ``changed``. Only
    this notices events cut off at the end of a chain, or a chain that was
    sealed anew as a whole.
    """
    now = segment_heads(sealed, chain, seq).select(
        F.col(chain).alias("_c"), F.col("segment").alias("_s"), F.col("head").alias("_h"), F.col("n").alias("_n")
    )
    same = F.col(chain).eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s"))
    both = stored.select(chain, "segment", "head", "n").join(now, same, "full")
    finding = (
        F.when(F.col("_h").isNull() & F.col("_n").isNull(), "missing")
        .when(F.col("head").isNull() & F.col("n").isNull(), "unknown")
        .when(~F.col("head").eqNullSafe(F.col("_h")) | (F.col("n") != F.col("_n")), "changed")
    )
    return both.select(
        F.coalesce(F.col(chain), F.col("_c")).alias(chain),
        F.coalesce("segment", "_s").alias("segment"),
        finding.alias("finding"),
    ).filter("finding IS NOT NULL")


def verify_rows(
    sealed: DataFrame,
    chain: str,
    seq: str,
    body: Column,
    segment_rows: int | None = SEGMENT_ROWS,
    required: list[str] | None = None,
    chunk: int = 4_096,
) -> DataFrame:
    """Add ``valid`` to every row: link to the row before, hash, required fields.

    ``segment_rows=None`` checks one linear chain per key. Rows are compared
    with their predecessor only, in chunks, so a chain of any length is checked
    in parallel.
    """
    near = with_neighbours(sealed, [chain], seq, ["hash", seq], preceding=1, chunk=chunk)
    first = F.col(seq) == 0
    if segment_rows:
        first = F.col(seq) % segment_rows == 0
    follows = F.coalesce(
        (F.col(f"{seq}_prev1") == F.col(seq) - 1) & (F.col("prev_hash") == F.col("hash_prev1")),
        F.lit(False),
    )
    # A segment start still needs the row before it to exist.
    gapless = (F.col(seq) == 0) | F.coalesce(
        F.col(f"{seq}_prev1") == F.col(seq) - 1, F.lit(False)
    )
    part = F.floor(F.col(seq) / segment_rows).cast("bigint") if segment_rows else F.lit(0)
    start = segment_start(F.col(chain), part)
    linked = F.when(first, gapless & (F.col("prev_hash") == start)).otherwise(follows)
    rehashed = chain_hash(F.col("prev_hash"), body)
    ok = linked & (F.col("hash") == rehashed)
    for c in required or []:
        ok = ok & F.col(c).isNotNull()
    return near.withColumn("valid", F.coalesce(ok, F.lit(False))).drop(
        "hash_prev1", f"{seq}_prev1"
    )


def verify_chains(verified: DataFrame, chain: str, seq: str) -> DataFrame:
    """Verdict per chain and the first position that breaks it."""
    return verified.groupBy(chain).agg(
        F.count(F.lit(1)).alias("events"),
        F.bool_and("valid").alias("valid"),
        F.min(F.when(~F.col("valid"), F.col(seq))).alias("first_bad"),
    )


def last_events(events: DataFrame, n: int = 50, order: str = "seq") -> DataFrame:
    """The last n events in order; n between 1 and 1000."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be between 1 and 1000")
    return events.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def scan_trail(
    results: DataFrame,
    subject: str,
    event_type: str,
    actor: str,
    payload: dict[str, Column],
    at: Column,
) -> DataFrame:
    """Audit rows of a scan: one per result, the subject as trace id in the payload."""
    return results.select(
        F.lit(event_type).alias("event_type"),
        F.lit(actor).alias("actor"),
        utc_text(at).alias("timestamp"),
        canonical_json({**payload, "trace_id": F.col(subject).cast("string")}).alias(
            "payload_json"
        ),
    )


# -- traces -------------------------------------------------------------------------


def correlated(
    events: DataFrame, key: str, payload: str = "payload_json", name: str = "trace_value"
) -> DataFrame:
    """Events that carry the correlation key, with its value; the others are left out."""
    value = F.get_json_object(payload, f"$.{key}")
    return events.withColumn(name, value).filter(F.col(name).isNotNull())


def trace_members(events: DataFrame, key: str, value: str, payload: str = "payload_json"):
    """Events of one trace."""
    return correlated(events, key, payload).filter(F.col("trace_value") == value)


def trace_links(
    events: DataFrame,
    key: str,
    payload: str = "payload_json",
    ts: str = "ts",
    seq: str = "seq",
    event_type: str = "event_type",
) -> DataFrame:
    """One row per correlation value: size, types in first-seen order, first and last time.

    The member events stay rows (:func:`correlated`); gathering them into one
    array would put a popular value into one task. Types are reduced per
    (value, type) first, so only the short list of types is ever collected.
    """
    found = correlated(events, key, payload)
    per_type = found.groupBy("trace_value", F.col(event_type).alias("_type")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"))).alias("_first"),
        F.min(seq).alias("_seen"),
        F.max(ts).alias("_last"),
    )
    types = F.array_sort(F.collect_list(F.struct("_first", "_type")))
    return per_type.groupBy("trace_value").agg(
        F.sum("_n").alias("events"),
        F.transform(types, lambda x: x["_type"]).alias("event_types"),
        F.min("_first.t").alias("first_ts"),
        F.max("_last").alias("last_ts"),
        F.min("_seen").alias("first_seen"),
    )
