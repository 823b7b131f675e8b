"""The named queries of this package, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.llm.chat import conversations_of, format_preferences, mask_text, swapped_replies
from govlattice.llm.collocations import collocations
from govlattice.llm.common import read
from govlattice.llm.decontamination import find_contamination
from govlattice.llm.language_model import score_texts
from govlattice.llm.line_runs import drop_repeated_lines
from govlattice.llm.main_text import extract_main_text
from govlattice.llm.packing import pack_documents
from govlattice.llm.quality import judge_quality
from govlattice.llm.repeats import remove_repeats
from govlattice.llm.simhash import near_duplicates
from govlattice.llm.tokens import token_digest
from govlattice.llm.url_rules import host_rule, judge_urls
from govlattice.llm.whitening import whiten

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]


def op1_token_files(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents")
    return token_digest(docs, public_tokenizers.path(TOKENIZER), end=2)


def op2_url_automaton(spark: SparkSession, base: str) -> DataFrame:
    pages = read(spark, base, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).drop("url")


def op3_site_style_tree(spark: SparkSession, base: str) -> DataFrame:
    return extract_main_text(read(spark, base, "pages"))


def op4_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), end=1, capacity=4096)


def op5_quality_cascade(spark: SparkSession, base: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge_quality(read(spark, base, "documents").select("doc_id", "text")).select(*names)


def op6_positional_decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = find_contamination(read(spark, base, "documents"), spark.read.parquet(f"{base}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_simhash_bk_trees(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates(read(spark, base, "documents"), shingle=4, radius=4, seed=42)


def op8_preference_pairs(spark: SparkSession, base: str) -> DataFrame:
    conversations = conversations_of(read(spark, base, "conversations"))
    pairs = format_preferences(swapped_replies(conversations, F.col("_conv").bitwiseXOR(F.lit(1))))
    masks = {c: mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(masks)


def op9_log_bilinear_scores(spark: SparkSession, base: str) -> DataFrame:
    return score_texts(read(spark, base, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, base: str) -> DataFrame:
    found = remove_repeats(read(spark, base, "documents"), least=400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_collocations(spark: SparkSession, base: str) -> DataFrame:
    return collocations(read(spark, base, "documents"))


def op12_line_runs(spark: SparkSession, base: str) -> DataFrame:
    found = drop_repeated_lines(read(spark, base, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_refined_whitening(spark: SparkSession, base: str) -> DataFrame:
    found = whiten(read(spark, base, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_url_automaton,
        op3_site_style_tree,
        op4_best_fit_packing,
        op5_quality_cascade,
        op6_positional_decontamination,
        op7_simhash_bk_trees,
        op8_preference_pairs,
        op9_log_bilinear_scores,
        op10_suffix_array_dedup,
        op11_collocations,
        op12_line_runs,
        op13_refined_whitening,
    )
}

_URL_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, verdict, rule_host, rule_path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
j AS (
  SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS n
  FROM u LEFT JOIN r ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""

_SPLIT_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_SPLIT_WORDS.format("text")} AS ws FROM d),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
      FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS r(i)),
twice AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w)
  LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
  OR 2 * n_dup_lines > n_words) AS kept FROM b
"""

_ITEM_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS.format(_LOWER)} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS.format(_LOWER)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS t
       FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS t
       FROM d, sizes, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS r(i)),
hit AS (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.t = bw.t),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, size)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _render_sql(turns: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text"
        " || '<|im_end|>' || chr(10)), ''), '')"
    )


def _mask_sql(turns: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({turns}, lambda t: (length(t.role) + length(t.text) + 24)::VARCHAR"
        " || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END), ','), '')"
    )


_CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS ts
  FROM conversations GROUP BY conv_id),
n AS (SELECT *, coalesce(list_max(list_transform(ts, lambda t, i: CASE WHEN t.role = 'assistant' THEN i ELSE 0 END)), 0) AS n FROM c),
p AS (
  SELECT a.conv_id, CASE WHEN a.n > 0 THEN a.ts[1 : a.n] ELSE a.ts END AS ch,
    CASE WHEN a.n = 0 THEN a.ts WHEN b.n > 0 THEN list_concat(a.ts[1 : a.n - 1], b.ts[b.n : b.n]) ELSE a.ts[1 : a.n - 1] END AS rj
  FROM n AS a LEFT JOIN n AS b ON xor(a.conv_id, 1) = b.conv_id AND b.n > 0),
k AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(ch), len(rj)) + 1),
    lambda i: ch[i] IS DISTINCT FROM rj[i])) - 1, len(ch)) AS n_common FROM p)
SELECT conv_id, n_common::BIGINT AS n_common, {_render_sql("ch[1 : n_common]")} AS prompt,
  {_render_sql("ch[n_common + 1 :]")} AS chosen, {_render_sql("rj[n_common + 1 :]")} AS rejected,
  {_mask_sql("ch[n_common + 1 :]")} AS chosen_mask, {_mask_sql("rj[n_common + 1 :]")} AS rejected_mask
FROM k
"""

_COLLOCATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
one AS (SELECT lang, x, count(*) AS c FROM t GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) AS c FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM one GROUP BY lang),
cover AS (SELECT lang, x, y, max(c) AS c FROM (
    SELECT lang, x, y, c FROM three UNION ALL SELECT lang, y, z, c FROM three) GROUP BY ALL),
pairs AS (
  SELECT two.lang, two.x || ' ' || two.y AS phrase, two.c AS a, o.c AS l, q.c AS r
  FROM two JOIN one AS o ON o.lang = two.lang AND o.x = two.x JOIN one AS q ON q.lang = two.lang AND q.x = two.y
  LEFT JOIN cover AS v ON v.lang = two.lang AND v.x = two.x AND v.y = two.y
  WHERE two.c >= 10 AND NOT coalesce(100 * v.c >= 50 * two.c, false)),
cuts AS (
  SELECT k.lang, k.x || ' ' || k.y || ' ' || k.z AS phrase, k.c AS a, 1 AS cut, o.c AS l, q.c AS r
  FROM three AS k JOIN one AS o ON o.lang = k.lang AND o.x = k.x JOIN two AS q ON q.lang = k.lang AND q.x = k.y AND q.y = k.z
  UNION ALL
  SELECT k.lang, k.x || ' ' || k.y || ' ' || k.z, k.c, 2, o.c, q.c
  FROM three AS k JOIN two AS o ON o.lang = k.lang AND o.x = k.x AND o.y = k.y JOIN one AS q ON q.lang = k.lang AND q.x = k.z),
scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score
  FROM (SELECT *, 1 AS cut FROM pairs UNION ALL BY NAME SELECT * FROM cuts)),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least_cut JOIN total USING (lang) QUALIFY rank <= 2000
"""

_LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(ls) + 1)) AS r(i)),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, coalesce(f.top <> l.doc_id, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES = {
    "op2_url_automaton": _URL_SQL,
    "op5_quality_cascade": _QUALITY_SQL,
    "op6_positional_decontamination": _CONTAMINATION_SQL,
    "op8_preference_pairs": _CHAT_SQL,
    "op11_collocations": _COLLOCATION_SQL,
    "op12_line_runs": _LINE_SQL,
}
