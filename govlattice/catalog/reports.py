"""Queries: impact reports and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.catalog.common import lit
from govlattice.catalog.knowledge import TFIDF_SQL
from govlattice.operators import audit as A
from govlattice.operators.personal_data import detect_personal_data
from govlattice.operators.policy import evaluate_policies
from govlattice.operators.prompts import scan_prompts
from govlattice.operators.retrieval import nearest_of_small_corpus
from govlattice.plans import impact_report as R
from govlattice.rules.levels import LEGAL_BASIS_LABEL_PT, LEGAL_BASES
from govlattice.session import cut_lineage, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


CATS = {"en": ["personal"], "de": ["sensitive", "personal"], "fr": ["anonymized"], "es": ["sensitive"]}


def projects(spark, base):
    """One project per document; the sample prompt is the document of every third one."""
    cats = F.array().cast("array<string>")
    for lang, values in CATS.items():
        cats = F.when(F.col("lang") == lang, F.array(*[F.lit(v) for v in values])).otherwise(cats)
    basis = F.lit(LEGAL_BASES[-1])
    for i, b in enumerate(LEGAL_BASES[:-1]):
        basis = F.when(F.col("doc_id") % len(LEGAL_BASES) == i, b).otherwise(basis)
    context = F.create_map(
        F.lit("automated_decision"),
        F.when(F.expr("doc_id % 4 = 0"), "true").otherwise("false"),
        F.lit("legal_effect"),
        F.lit("true"),
        F.lit("sample_prompt"),
        F.when(F.expr("doc_id % 3 = 0"), F.col("text")).otherwise(""),
    )
    return table(spark, base, "documents").select(
        F.col("doc_id").alias("project_id"),
        F.concat(F.lit("Projeto "), F.col("doc_id").cast("string")).alias("project_name"),
        F.col("text").alias("description"),
        cats.alias("data_categories"),
        basis.alias("legal_basis"),
        context.alias("context"),
    )


def passages(spark, base):
    return table(spark, base, "benchmark").select(
        F.lpad(F.col("item_id").cast("string"), 8, "0").alias("source"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("article"),
        "text",
    )


def _reports(spark, base):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return R.generate_reports(projects(spark, base), passages(spark, base), generated_at=at)


@query("impact_reports")
def impact_reports(spark, base):
    return _reports(spark, base).select(
        "project_id",
        "score",
        "risk_level",
        F.size("pii").alias("findings"),
        F.size("decisions").alias("decisions"),
        F.size("mitigations").alias("mitigations"),
        "narrative",
        "executive_summary",
    )


@query("report_lines")
def report_lines(spark, base):
    return R.report_table(_reports(spark, base))


@query("report_audit_chain")
def report_audit_chain(spark, base):
    """Audit events of the reports, sealed in one linear chain per risk level."""
    reports = _reports(spark, base)
    rows = R.report_audit_rows(reports, keep=["risk_level"])
    from govlattice.functions.scale import dense_position

    # Written once: places are counted and given in two passes, and each would make the reports anew.
    events = cut_lineage(rows.select("project_id", "event_type", "actor", "timestamp", "payload_json", F.col("risk_level").alias("chain_id")))
    placed = dense_position(
        events,
        ["chain_id"],
        ["project_id"],
        F.floor(F.col("project_id") / 1024),
        "seq",
    )
    body = A.event_body(F.col("event_type"), F.col("actor"), F.col("timestamp"), F.col("payload_json"))
    sealed = A.seal(placed, "chain_id", "seq", body, segment_rows=None)
    rows = A.verify_rows(sealed, "chain_id", "seq", body, segment_rows=None)
    return A.verify_chains(rows, "chain_id", "seq")


REF_SQL = TFIDF_SQL.replace("side = 'd' GROUP BY 1)", "side = 'q' GROUP BY 1)").replace(
    "SELECT count(*) AS n FROM documents", "SELECT count(*) AS n FROM benchmark"
)


@query(
    "documents_to_passages",
    REF_SQL
    + """, s AS (SELECT d.id AS doc_id, q.id AS item_id, round(sum(q.w * d.w), 6) AS score
          FROM u q JOIN u d ON q.b = d.b AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
        a AS (SELECT doc_id, item_id, coalesce(score, 0) AS score FROM (SELECT doc_id, item_id FROM documents, benchmark) g LEFT JOIN s USING (doc_id, item_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM a)
        SELECT doc_id, item_id, rank::INT AS rank, round(score::DECIMAL(18, 6), 4)::DOUBLE AS score FROM r WHERE rank <= 3""",
)
def documents_to_passages(spark, base):
    """For every document the three most similar benchmark passages."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    near = nearest_of_small_corpus(docs, passages(spark, base), "text", 3)
    return near.select("doc_id", F.posexplode("nearest").alias("i", "p")).select(
        "doc_id",
        F.col("p.source").cast("bigint").alias("item_id"),
        (F.col("i") + 1).alias("rank"),
        F.col("p.score").alias("score"),
    )


@query(
    "regulatory_query_texts",
    "SELECT doc_id AS project_id, md5(trim(text || ' Categorias de dado envolvidas: ' || CASE lang WHEN 'en' THEN 'pessoal' "
    "WHEN 'de' THEN 'sensível, pessoal' WHEN 'fr' THEN 'anonimizado' WHEN 'es' THEN 'sensível' ELSE 'não especificada' END "
    "|| '. Base legal declarada: ' || CASE doc_id % 6 "
    + " ".join(f"WHEN {i} THEN {lit(LEGAL_BASIS_LABEL_PT[b])}" for i, b in enumerate(LEGAL_BASES))
    + " END || '.')) AS search_text FROM documents",
)
def regulatory_query_texts(spark, base):
    return projects(spark, base).select(
        "project_id",
        F.md5(
            R.regulatory_query(F.col("description"), F.col("data_categories"), F.col("legal_basis"))
        ).alias("search_text"),
    )


@query(
    "decision_lines",
    """SELECT doc_id AS project_id, 'POL-009' AS policy_id, 'allow' AS status, 'low' AS risk_level, '—' AS mitigations FROM documents
         WHERE lang = 'en' AND doc_id % 6 <> 5
       UNION ALL SELECT doc_id, 'POL-008', 'requires_human_review', 'medium', 'Choose a legal basis before processing' FROM documents
         WHERE lang IN ('en', 'de', 'es') AND doc_id % 6 = 5
       UNION ALL SELECT doc_id, 'POL-005', 'allow', 'low', '—' FROM documents WHERE lang = 'fr'
       UNION ALL SELECT doc_id, 'POL-006', 'deny', 'critical', 'Make the decision explainable before release' FROM documents WHERE doc_id % 4 = 0""",
)
def decision_lines(spark, base):
    evaluated = evaluate_policies(projects(spark, base))
    return R.decisions_table(evaluated, ["project_id"]).drop("rationale")


@query("finding_lines")
def finding_lines(spark, base):
    detected = detect_personal_data(projects(spark, base), "description")
    return R.findings_table(detected, ["project_id"])


@query(
    "category_parsing",
    """SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(p_name, ' ', ' , ') || chr(10) || p_brand, '[,' || chr(10) || ']'), lambda x: trim(x)), lambda x: x <> ''), '|') AS categories FROM part""",
)
def category_parsing(spark, base):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit("\n"), F.col("p_brand"))
    return table(spark, base, "part").select(
        "p_partkey", F.array_join(R.parse_categories(raw), "|").alias("categories")
    )


@query("scan_audit_trail")
def scan_audit_trail(spark, base):
    """Audit rows of a prompt scan over all conversation turns."""
    scanned = scan_prompts(table(spark, base, "conversations"))
    return A.scan_trail(
        scanned.withColumn("trace", F.concat_ws("-", "conv_id", "turn")),
        "trace",
        "prompt_security_scan",
        "scanner",
        {"score": F.col("score"), "is_safe": F.col("is_safe")},
        F.lit("2024-02-01 00:00:00"),
    )
