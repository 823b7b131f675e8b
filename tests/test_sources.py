import json

import pytest
from pyspark.sql import functions as F

from govlattice.functions.text import valid_check_digits
from govlattice.operators import audit as A
from govlattice.rules.personal_data import CPF_WEIGHTS
from govlattice.sources import corpus, stores, synthetic


def test_corpus(spark, tmp_path):
    (tmp_path / "b.txt").write_text("Artigo: 20º\nTema: um\nTema: dois\n\n# Resumo ilustrativo x\nCorpo.\n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("so texto", encoding="utf-8")
    (tmp_path / "c.md").write_text("nada", encoding="utf-8")
    rows = corpus.load_corpus(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r.source, r.article, r.tema) for r in rows] == [("a.txt", None, None), ("b.txt", "20º", "dois")]
    assert rows[0].text == "so texto" and rows[1].text == "# Resumo ilustrativo x\nCorpo."
    df = spark.createDataFrame(rows)
    out = df.select(corpus.indexing_text(F.col("text"), F.col("tema")).alias("t"), corpus.chunk_id(F.lit(1), F.col("article")).alias("i")).collect()
    assert out[1].t == "dois\n\nCorpo." and out[1].i == "chunk-001-art20" and out[0].i == "chunk-001-artna"
    assert corpus.load_corpus(spark, str(tmp_path / "none")).count() == 0


def test_document_scan(spark, tmp_path):
    (tmp_path / "x.TXT").write_bytes("cpf 111.444.777-35 \xff".encode("latin-1"))
    (tmp_path / "y.pdf").write_bytes(b"%PDF")
    good, bad = corpus.scan_documents(spark, str(tmp_path))
    row = good.collect()[0]
    assert row.file_name == "x.TXT" and row.file_type == "txt" and row.pii[0].entity_type == "CPF"
    assert row.characters_extracted == 20
    assert [r.file_name for r in bad.collect()] == ["y.pdf"]


def test_manifest_snapshots(spark, tmp_path):
    path = str(tmp_path / "m")
    assert stores.load_manifest(spark, path) is None
    one = stores.manifest_of(spark.createDataFrame([("a", "1"), ("b", "2")], "source string, text string"))
    two = stores.manifest_of(spark.createDataFrame([("a", "9"), ("c", "3")], "source string, text string"))
    stores.save_manifest(one, path, "2024-01-01")
    stores.save_manifest(two, path, "2024-01-02")
    old, new = stores.load_manifest(spark, path, "2024-01-01"), stores.load_manifest(spark, path)
    assert {(r.filename, r.change) for r in stores.diff_manifests(old, new).collect()} == {
        ("a", "modified"), ("b", "removed"), ("c", "added")
    }


def test_audit_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", i, str(i), "t", "me", "now", "{}") for i in range(5)],
        "chain_id string, seq bigint, event_id string, event_type string, actor string, timestamp string, payload_json string")
    body = A.event_body(F.col("event_type"), F.col("actor"), F.col("timestamp"), F.col("payload_json"))
    stores.append_audit_log(A.seal(rows, "chain_id", "seq", body), path)
    back = stores.read_audit_log(spark, path)
    ok = A.verify_chains(A.verify_rows(back, "chain_id", "seq", body), "chain_id", "seq").collect()
    assert [(r.events, r.valid) for r in ok] == [(5, True)]
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    bad = A.verify_rows(stores.read_audit_log(spark, path), "chain_id", "seq", body)
    assert bad.filter("NOT valid").count() == 1


def test_small_files(spark, tmp_path):
    (tmp_path / "m1.json").write_text(json.dumps({"status": "done", "tests_passed": 3, "tests_total": 4}))
    (tmp_path / "m2.json").write_text("[broken")
    out = {r.module: r.status for r in stores.load_statuses(spark, str(tmp_path), ["m1", "m2", "m3"]).collect()}
    assert out == {"m1": "done", "m2": None, "m3": None}
    rules = tmp_path / "r.json"
    rules.write_text("")
    assert stores.load_rules(str(rules)) == []
    rules.write_text('[{"id": "A"}]')
    assert stores.load_rules(str(rules))[0]["id"] == "A"


def test_synthetic_people(spark):
    a = synthetic.synthetic_people(spark, 50, 1)
    assert a.orderBy("id").collect() == synthetic.synthetic_people(spark, 50, 1).repartition(3).orderBy("id").collect()
    digits = F.regexp_replace("cpf", r"\D", "")
    assert a.filter(valid_check_digits(digits, CPF_WEIGHTS)).count() == 50
    assert a.filter("synthetic").count() == 50
    with pytest.raises(ValueError):
        synthetic.synthetic_people(spark, -1)


def test_only_references_are_unescaped(spark):
    """As html.unescape over the whole text, which itself never goes to Python."""
    import html

    from govlattice.sources.markup import unescape
    from pyspark.sql import functions as F

    texts = ["", "a", "&amp;", "x&amp;lt;y", "&ampx;", "&#65;&#x42 &#0;", "&#x110000;", "a&notit;b", "& &; &&amp;&", "t&copy", "&#;&#xZ;", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u"))
    assert [r["u"] for r in rows.collect()] == [None if t is None else html.unescape(t) for t in texts]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_unescape_series(CASE WHEN Contains(t" in plan and "regexp_extract_all" in plan
