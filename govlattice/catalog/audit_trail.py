"""Queries: sealing, verification, checkpoints, proofs, traces, lifecycle, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.functions.scale import dense_position
from govlattice.operators import audit as A
from govlattice.operators import lifecycle as L
from govlattice.operators import merkle as M
from govlattice.operators import merkle_log as G
from govlattice.session import cut_lineage, table
from govlattice.sources import stores

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


SEGMENT = 32
BATCH = 16


def audit_events(spark, base):
    """Events as audit rows: one chain per user, dense positions, canonical payload."""
    events = table(spark, base, "events").select("event_id", "user_id", "event_type", "props", "ts")
    placed = dense_position(
        events, ["user_id"], ["event_id"], F.floor(F.col("event_id") / 4096), "seq"
    )
    return placed.select(
        F.col("user_id").alias("chain_id"),
        "seq",
        "event_id",
        "event_type",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.col("props").alias("payload_json"),
    )


def body():
    return A.event_body(
        F.col("event_type"), F.col("actor"), F.col("timestamp"), F.col("payload_json")
    )


SEAL_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS chain_id, event_id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
      event_type || 'user-' || user_id || epoch_us(ts)::VARCHAR || props AS body FROM events),
    f AS (SELECT *, CASE WHEN seq = 0 THEN repeat('0', 64)
          ELSE sha256(repeat('0', 64) || chr(31) || chain_id || chr(31) || (seq // {SEGMENT})) END AS start
        FROM e WHERE seq % {SEGMENT} = 0),
    s AS (SELECT chain_id, seq, event_id, start AS prev_hash, sha256(start || body) AS hash FROM f
      UNION ALL SELECT e.chain_id, e.seq, e.event_id, s.hash, sha256(s.hash || e.body)
        FROM s JOIN e ON e.chain_id = s.chain_id AND e.seq = s.seq + 1 AND e.seq % {SEGMENT} <> 0)"""


def _sealed(spark, base):
    return A.seal(audit_events(spark, base), "chain_id", "seq", body(), SEGMENT)


@query("audit_seal", SEAL_SQL + " SELECT chain_id, seq::BIGINT AS seq, event_id, prev_hash, hash FROM s")
def audit_seal(spark, base):
    return _sealed(spark, base).select("chain_id", "seq", "event_id", "prev_hash", "hash")


@query(
    "audit_segment_heads",
    SEAL_SQL
    + f""", h AS (SELECT chain_id, seq // {SEGMENT} AS part, arg_max(hash, seq) AS head, count(*) AS n FROM s GROUP BY 1, 2),
     c AS (SELECT chain_id, part, sha256(repeat('0', 64) || head || chr(31) || n) AS hash FROM h WHERE part = 0
       UNION ALL SELECT h.chain_id, h.part, sha256(c.hash || h.head || chr(31) || h.n)
         FROM c JOIN h ON h.chain_id = c.chain_id AND h.part = c.part + 1)
     SELECT chain_id, part::BIGINT AS part, hash FROM c""",
)
def audit_segment_heads(spark, base):
    return A.seal_heads(_sealed(spark, base), "chain_id", "seq").select("chain_id", "part", "hash")


@query(
    "audit_verification",
    """WITH e AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events),
       k AS (SELECT * FROM e WHERE event_id % 997 <> 5),
       b AS (SELECT chain_id, seq, event_id % 991 = 3
            OR (seq > 0 AND seq - 1 IS DISTINCT FROM lag(seq) OVER (PARTITION BY chain_id ORDER BY seq)) AS bad FROM k)
       SELECT chain_id, count(*)::BIGINT AS events, NOT bool_or(bad) AS valid,
         (min(seq) FILTER (WHERE bad))::BIGINT AS first_bad FROM b GROUP BY 1""",
)
def audit_verification(spark, base):
    """Some payloads changed and some rows removed after sealing: which chains notice, where."""
    tampered = (
        _sealed(spark, base)
        .filter("event_id % 997 <> 5")
        .withColumn(
            "payload_json",
            F.when(F.expr("event_id % 991 = 3"), F.lit("{}")).otherwise(F.col("payload_json")),
        )
    )
    rows = A.verify_rows(tampered, "chain_id", "seq", body(), SEGMENT, ["event_type", "actor"])
    return A.verify_chains(rows, "chain_id", "seq")


@query(
    "audit_seal_linear",
    """WITH RECURSIVE e AS (SELECT user_id AS chain_id, event_id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
      event_type || 'user-' || user_id || epoch_us(ts)::VARCHAR || props AS body FROM events),
    s AS (SELECT chain_id, seq, event_id, sha256(repeat('0', 64) || body) AS hash FROM e WHERE seq = 0
      UNION ALL SELECT e.chain_id, e.seq, e.event_id, sha256(s.hash || e.body)
        FROM s JOIN e ON e.chain_id = s.chain_id AND e.seq = s.seq + 1)
    SELECT chain_id, seq::BIGINT AS seq, event_id, hash FROM s""",
)
def audit_seal_linear(spark, base):
    """One linear chain per user, whatever its length."""
    sealed = A.seal(audit_events(spark, base), "chain_id", "seq", body(), None)
    return sealed.select("chain_id", "seq", "event_id", "hash")


def _tampered(spark, base):
    """Sealed chains; segments swapped, removed and renumbered, or a payload changed, by chain."""
    sealed = _sealed(spark, base)
    sizes = sealed.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    rows = sealed.join(sizes, "chain_id")
    swap = F.expr(f"chain_id % 4 = 0 AND n >= {2 * SEGMENT}")
    cut = F.expr(f"chain_id % 4 = 1 AND n > {2 * SEGMENT}")
    place = F.floor(F.col("seq") / SEGMENT)
    return (
        rows.filter(~(cut & (place == 1)))
        .withColumn(
            "seq",
            F.when(swap & (place == 0), F.col("seq") + SEGMENT)
            .when((swap & (place == 1)) | (cut & (place > 1)), F.col("seq") - SEGMENT)
            .otherwise(F.col("seq")),
        )
        .withColumn(
            "payload_json",
            F.when(F.expr("chain_id % 4 = 2 AND seq = 40"), F.lit("{}")).otherwise(F.col("payload_json")),
        )
    )


@query(
    "audit_tampering",
    f"""WITH c AS (SELECT user_id AS chain_id, count(*) AS n FROM events GROUP BY 1),
      b AS (SELECT *, CASE WHEN chain_id % 4 = 0 AND n >= {2 * SEGMENT} THEN 0
          WHEN chain_id % 4 = 1 AND n > {2 * SEGMENT} THEN {SEGMENT}
          WHEN chain_id % 4 = 2 AND n > 40 THEN 40 END AS first_bad FROM c)
      SELECT chain_id, (n - CASE WHEN chain_id % 4 = 1 AND n > {2 * SEGMENT} THEN {SEGMENT} ELSE 0 END)::BIGINT AS events,
        first_bad IS NULL AS valid, first_bad::BIGINT AS first_bad FROM b""",
)
def audit_tampering(spark, base):
    """Whole segments swapped or removed, and changed payloads: found, and where."""
    rows = A.verify_rows(_tampered(spark, base), "chain_id", "seq", body(), SEGMENT, ["event_type", "actor"])
    return A.verify_chains(rows, "chain_id", "seq")


@query(
    "audit_head_check",
    f"""WITH e AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
      h AS (SELECT chain_id, seq // {SEGMENT} AS segment, count(*) AS n, max(seq) AS last FROM e GROUP BY 1, 2),
      t AS (SELECT chain_id, max(seq) AS top FROM e GROUP BY 1)
      SELECT chain_id, segment::BIGINT AS segment, CASE WHEN n = 1 THEN 'missing' ELSE 'changed' END AS finding
      FROM h JOIN t USING (chain_id) WHERE chain_id % 5 = 2 AND last = top""",
)
def audit_head_check(spark, base):
    """Chains whose last event was cut off: valid on their own, but not against the stored heads."""
    sealed = _sealed(spark, base)
    stored = A.segment_heads(sealed, "chain_id", "seq")
    last = sealed.groupBy("chain_id").agg(F.max("seq").alias("top"))
    short = sealed.join(last, "chain_id").filter(~F.expr("chain_id % 5 = 2 AND seq = top"))
    return A.verify_heads(short, stored, "chain_id", "seq")


TREE_SQL = """, tree AS ({leaves}),
    up AS (SELECT t, 0 AS lvl, pos, h, n FROM tree
      UNION ALL SELECT t, lvl + 1, pos // 2, sha256(max(CASE WHEN pos % 2 = 0 THEN h END)
          || coalesce(max(CASE WHEN pos % 2 = 1 THEN h END), max(CASE WHEN pos % 2 = 0 THEN h END))), max((n + 1) // 2)
        FROM up WHERE n > 1 GROUP BY t, lvl, pos // 2)"""


ROOTS_SQL = (
    "WITH RECURSIVE z AS (SELECT 1)"
    + TREE_SQL.format(
        leaves="SELECT l_suppkey AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos, "
        "sha256(l_orderkey || ':' || l_linenumber) AS h, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem"
    )
    + """ SELECT u.t AS l_suppkey, u.h AS root, c.n::BIGINT AS leaves FROM up u
        JOIN (SELECT t, count(*) AS n FROM tree GROUP BY 1) c USING (t) WHERE u.n = 1"""
)


def _supplier_items(spark, base):
    items = table(spark, base, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return dense_position(
        items,
        ["l_suppkey"],
        ["l_orderkey", "l_linenumber"],
        F.floor(F.col("l_orderkey") / 8192),
    )


def _leaves(items):
    leaf = F.sha2(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")),
        256,
    )
    return items.withColumn("hash", leaf)


def _supplier_leaves(spark, base):
    return _leaves(_supplier_items(spark, base)).select("l_suppkey", "pos", "hash")


@query("merkle_roots", ROOTS_SQL)
def merkle_roots(spark, base):
    """One tree per supplier over its line items."""
    return M.merkle_roots(_supplier_leaves(spark, base), ["l_suppkey"])


@query("merkle_log_roots", ROOTS_SQL)
def merkle_log_roots(spark, base):
    """The same trees as logs that grow by three appends; each hashes only the new items."""
    leaves = cut_lineage(_supplier_leaves(spark, base))
    part = F.when(F.col("pos") < 100, 0).when(F.col("pos") < 100 + F.col("l_suppkey") % 64, 1).otherwise(2)
    peaks = None
    for k in range(3):
        _, peaks = G.append_leaves(peaks, leaves.filter(part == k), ["l_suppkey"])
    return G.log_roots(peaks, ["l_suppkey"])


@query(
    "merkle_log_proofs",
    """SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos,
        ceil(log2(count(*) OVER (PARTITION BY l_suppkey)))::BIGINT AS steps, true AS valid FROM lineitem""",
)
def merkle_log_proofs(spark, base):
    """A proof of every line item in a log of two appends, folded and compared with the root of the peaks."""
    # Stored and shuffled without their hashes, which are longer than the items.
    items = cut_lineage(_supplier_items(spark, base))
    leaves = _leaves(items).select("l_suppkey", "pos", "hash")
    early = F.col("pos") < 77
    first, peaks = G.append_leaves(None, leaves.filter(early), ["l_suppkey"])
    second, peaks = G.append_leaves(peaks, leaves.filter(~early), ["l_suppkey"])
    proofs = G.log_proofs(first.unionByName(second), peaks, items, ["l_suppkey"], keep=["l_orderkey", "l_linenumber"])
    return M.verify_proofs(_leaves(proofs)).select("l_suppkey", "pos", F.size("path").cast("bigint").alias("steps"), "valid")


CHECKPOINT_SQL = (
    SEAL_SQL
    + TREE_SQL.format(
        leaves=f"SELECT chain_id || ':' || (seq // {BATCH}) AS t, seq % {BATCH} AS pos, hash AS h, "
        f"count(*) OVER (PARTITION BY chain_id, seq // {BATCH}) AS n FROM s"
    )
    + f""", cp AS (SELECT chain_id, seq // {BATCH} AS batch, chain_id || ':' || (seq // {BATCH}) AS checkpoint_id,
        min(seq) AS range_start, max(seq) + 1 AS range_end, count(*) AS event_count FROM s GROUP BY ALL),
      cr AS (SELECT cp.*, u.h AS merkle_root FROM cp JOIN up u ON u.t = cp.checkpoint_id AND u.n = 1),
      cc AS (SELECT *, sha256(repeat('0', 64) || checkpoint_id || range_start || range_end || merkle_root) AS hash FROM cr WHERE batch = 0
        UNION ALL SELECT cr.*, sha256(cc.hash || cr.checkpoint_id || cr.range_start || cr.range_end || cr.merkle_root)
          FROM cc JOIN cr ON cr.chain_id = cc.chain_id AND cr.batch = cc.batch + 1)"""
)


def _checkpoints(spark, base):
    return M.create_checkpoints(_sealed(spark, base), "chain_id", "seq", BATCH)


@query(
    "checkpoints",
    CHECKPOINT_SQL
    + """ SELECT checkpoint_id, range_start::BIGINT AS range_start, range_end::BIGINT AS range_end,
        event_count::BIGINT AS event_count, merkle_root, hash FROM cc""",
)
def checkpoints(spark, base):
    return _checkpoints(spark, base).select(
        "checkpoint_id", "range_start", "range_end", "event_count", "merkle_root", "hash"
    )


@query(
    "checkpoint_verification",
    CHECKPOINT_SQL
    + """ SELECT chain_id, count(*)::BIGINT AS events, true AS valid, NULL::BIGINT AS first_bad FROM cc GROUP BY 1""",
)
def checkpoint_verification(spark, base):
    rows = A.verify_rows(_checkpoints(spark, base), "chain_id", "batch", M.checkpoint_body())
    return A.verify_chains(rows, "chain_id", "batch")


@query(
    "inclusion_proofs",
    CHECKPOINT_SQL
    + f""" SELECT s.chain_id, s.seq::BIGINT AS seq, cr.checkpoint_id, cr.merkle_root,
        ceil(log2(greatest(cr.event_count, 1)))::BIGINT AS steps, true AS valid
        FROM s JOIN cr ON cr.chain_id = s.chain_id AND cr.batch = s.seq // {BATCH}""",
)
def inclusion_proofs(spark, base):
    """A proof for every event, folded and compared with the recorded root."""
    sealed = _sealed(spark, base)
    checks = M.create_checkpoints(sealed, "chain_id", "seq", BATCH)
    proofs = M.event_proofs(sealed, checks, "chain_id", "seq", BATCH)
    return proofs.select(
        "chain_id",
        "seq",
        "checkpoint_id",
        "merkle_root",
        F.size("path").cast("bigint").alias("steps"),
        "valid",
    )


@query(
    "events_to_checkpoint_ranges",
    """WITH e AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
       r AS (SELECT chain_id, k, CASE k WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 30 END AS a, CASE k WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 100000 END AS b
         FROM (SELECT DISTINCT chain_id FROM e), (VALUES (0), (1), (2)) v(k))
       SELECT e.chain_id, e.seq::BIGINT AS seq, e.chain_id || '#' || k AS checkpoint_id FROM e JOIN r
         ON e.chain_id = r.chain_id AND e.seq >= a AND e.seq < b""",
)
def events_to_checkpoint_ranges(spark, base):
    events = audit_events(spark, base).select("chain_id", "seq")
    last = events.groupBy("chain_id").agg((F.max("seq") + 31).alias("_end"))
    ranges = last.select(
        "chain_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("range_start"), b.cast("bigint").alias("range_end"))
                    for k, a, b in ((0, 0, F.lit(7)), (1, 7, F.lit(30)), (2, 30, F.col("_end")))
                ]
            )
        ),
    ).withColumn("checkpoint_id", F.concat(F.col("chain_id").cast("string"), F.lit("#"), F.col("k")))
    out = M.attach_checkpoints(events, ranges, "chain_id", "seq", 64)
    return out.select("chain_id", "seq", "checkpoint_id")


@query(
    "trace_links",
    """WITH e AS (SELECT json_extract_string(props, '$.k') AS trace_value, event_type, ts, event_id FROM events),
       t AS (SELECT trace_value, event_type, min(ts) AS f FROM e GROUP BY 1, 2),
       y AS (SELECT trace_value, string_agg(event_type, ',' ORDER BY f) AS event_types FROM t GROUP BY 1)
       SELECT trace_value, count(*)::BIGINT AS events, any_value(y.event_types) AS event_types,
         epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, min(event_id) AS first_seen
       FROM e JOIN y USING (trace_value) WHERE trace_value IS NOT NULL GROUP BY 1""",
)
def trace_links(spark, base):
    events = table(spark, base, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props"
    )
    out = A.trace_links(events, "k", payload="props", seq="event_id")
    return out.select(
        "trace_value",
        "events",
        F.array_join("event_types", ",").alias("event_types"),
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "first_seen",
    )


@query(
    "trace_members",
    """SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'""",
)
def trace_members(spark, base):
    events = table(spark, base, "events").select("event_id", "event_type", "props")
    return A.trace_members(events, "k", "7", payload="props").select("event_id", "event_type")


@query(
    "last_audit_events",
    "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
)
def last_audit_events(spark, base):
    events = table(spark, base, "events").select("event_id", "event_type")
    return A.last_events(events, 50, "event_id")


# -- lifecycle ----------------------------------------------------------------------


def _reviews(spark, base):
    events = table(spark, base, "events")
    items = (
        table(spark, base, "events").groupBy("user_id").agg(F.min("event_id").alias("created"))
        .filter("user_id % 5 > 0").select(F.col("user_id").alias("item_id"), "created")
    )
    decisions = events.filter("event_type IN ('purchase', 'error')").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "purchase").alias("approve"),
        F.lit("rev").alias("reviewer"),
        F.lit(None).cast("string").alias("notes"),
    )
    return items, decisions


REVIEW_SQL = """WITH i AS (SELECT user_id AS item_id FROM events WHERE user_id % 5 > 0 GROUP BY 1),
    d AS (SELECT user_id AS item_id, event_id AS seq, event_type = 'purchase' AS approve,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('purchase', 'error'))"""


@query(
    "oversight_state",
    REVIEW_SQL
    + """ SELECT i.item_id, CASE WHEN d.seq IS NULL THEN 'pending' WHEN approve THEN 'approved' ELSE 'rejected' END AS status,
        d.seq AS decided_seq FROM i LEFT JOIN d ON d.item_id = i.item_id AND rn = 1""",
)
def oversight_state(spark, base):
    items, decisions = _reviews(spark, base)
    return L.oversight_state(items, decisions).select("item_id", "status", "decided_seq")


@query(
    "rejected_decisions",
    REVIEW_SQL
    + """ SELECT item_id, seq, CASE WHEN item_id % 5 = 0 THEN 'unknown_item' ELSE 'already_decided' END AS reason
        FROM d WHERE item_id % 5 = 0 OR rn > 1""",
)
def rejected_decisions(spark, base):
    items, decisions = _reviews(spark, base)
    return L.rejected_decisions(items, decisions).select("item_id", "seq", "reason")


def _incidents(spark, base):
    events = table(spark, base, "events")
    incidents = events.select(F.col("user_id").alias("incident_id")).distinct()
    transitions = events.select(
        F.col("user_id").alias("incident_id"),
        F.col("event_id").alias("seq"),
        F.when(F.expr("event_id % 23 = 0"), "resolved")
        .when(F.expr("event_id % 3 = 0"), "investigating")
        .otherwise("open")
        .alias("status"),
        F.when(F.expr("event_id % 2 = 0"), F.lit("fixed")).otherwise("").alias("notes"),
    )
    return incidents, transitions


INCIDENT_SQL = """WITH t AS (SELECT user_id AS incident_id, event_id AS seq,
        CASE WHEN event_id % 23 = 0 THEN 'resolved' WHEN event_id % 3 = 0 THEN 'investigating' ELSE 'open' END AS status,
        CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE '' END AS notes FROM events),
    c AS (SELECT *, min(seq) FILTER (WHERE status = 'resolved' AND notes <> '') OVER (PARTITION BY incident_id) AS closed FROM t),
    j AS (SELECT *, CASE WHEN seq > closed THEN 'already_resolved' WHEN status = 'resolved' AND notes = '' THEN 'missing_notes' END AS reason FROM c)"""


@query(
    "incident_state",
    INCIDENT_SQL
    + """ SELECT incident_id, coalesce(arg_max(status, seq) FILTER (WHERE reason IS NULL), 'open') AS status,
        max(seq) FILTER (WHERE reason IS NULL AND status = 'resolved') AS resolved_seq FROM j GROUP BY 1""",
)
def incident_state(spark, base):
    return L.incident_state(*_incidents(spark, base)).select(
        "incident_id", "status", "resolved_seq"
    )


@query(
    "rejected_transitions",
    INCIDENT_SQL + " SELECT incident_id, seq, reason FROM j WHERE reason IS NOT NULL",
)
def rejected_transitions(spark, base):
    return L.rejected_transitions(*_incidents(spark, base)).select("incident_id", "seq", "reason")


# -- manifests ----------------------------------------------------------------------


@query(
    "manifest_diff",
    """WITH o AS (SELECT doc_id::VARCHAR AS filename, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1),
       n AS (SELECT doc_id::VARCHAR AS filename, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
       SELECT coalesce(o.filename, n.filename) AS filename, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed'
         WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (filename)""",
)
def manifest_diff(spark, base):
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("source"), "doc_id", "text")
    changed = F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = stores.manifest_of(docs.filter("doc_id % 10 <> 1"))
    new = stores.manifest_of(docs.filter("doc_id % 10 <> 2").withColumn("text", changed))
    return stores.diff_manifests(old, new)


@query(
    "manifest_summary",
    """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1),
       n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2),
       d AS (SELECT CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed'
         WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS c FROM o FULL JOIN n USING (doc_id))
       SELECT count(*) FILTER (WHERE c = 'added')::BIGINT AS added, count(*) FILTER (WHERE c = 'removed')::BIGINT AS removed,
         count(*) FILTER (WHERE c = 'modified')::BIGINT AS modified, count(*) FILTER (WHERE c = 'unchanged')::BIGINT AS unchanged FROM d""",
)
def manifest_summary(spark, base):
    return stores.summarize_diff(manifest_diff(spark, base))
