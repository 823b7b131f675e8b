"""Queries: corpus, markup, retrieval, article graph, synthetic people."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.catalog.common import LETTER
from govlattice.operators import graph as G
from govlattice.operators import retrieval as R
from govlattice.operators.personal_data import detect_personal_data
from govlattice.plans import whatif as W
from govlattice.session import cut_lineage, table
from govlattice.sources import corpus as C
from govlattice.sources import markup
from govlattice.sources.synthetic import with_person

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "front_matter",
    r"""WITH f AS (SELECT doc_id, 'Artigo: ' || doc_id || chr(10) || 'Tema:  ' || lang || chr(10) || 'tema: ' || source || chr(10) || chr(10) || text AS raw FROM documents)
       SELECT doc_id, 'Artigo ' || doc_id AS label, source AS tema,
         md5(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS body FROM f JOIN documents USING (doc_id)"""
    .replace("SELECT doc_id, 'Artigo ' || doc_id AS label, source AS tema,", "SELECT d.doc_id, 'Artigo ' || d.doc_id AS label, d.source AS tema,")
    .replace("md5(regexp_replace(text,", "md5(regexp_replace(d.text,")
    .replace("FROM f JOIN documents USING (doc_id)", "FROM f JOIN documents d USING (doc_id)"),
)
def front_matter(spark, base):
    files = table(spark, base, "documents").select(
        F.col("doc_id").cast("string").alias("source"),
        F.concat(
            F.lit("Artigo: "), F.col("doc_id").cast("string"),
            F.lit("\nTema:  "), F.col("lang"),
            F.lit("\ntema: "), F.col("source"),
            F.lit("\n\n"), F.col("text"),
        ).alias("raw"),
    )
    parsed = C.parse_corpus(files)
    return parsed.select(
        F.col("source").cast("bigint").alias("doc_id"),
        F.concat(F.lit("Artigo "), F.col("article")).alias("label"),
        "tema",
        F.md5("text").alias("body"),
    )


@query(
    "indexing_texts",
    r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
       b AS (SELECT doc_id, lang, string_agg(line, chr(10) ORDER BY i) AS body FROM l
         WHERE NOT starts_with(regexp_replace(line, '^[\s\p{Z}]+', ''), '# Resumo ilustrativo') GROUP BY ALL)
       SELECT doc_id, md5(lang || chr(10) || chr(10) || regexp_replace(body, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS prepared FROM b""",
)
def indexing_texts(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "lang", "text")
    return docs.select(
        "doc_id", F.md5(C.indexing_text(F.col("text"), F.col("lang"))).alias("prepared")
    )


@query(
    "markup_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
          '(?is)<title\b.*?</title\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
       b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g'),
          '(?i)<br\s*/?>|</?(?:p|div|h[1-6]|tr|li|table|blockquote|center)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM a),
       c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
       l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c),
       s AS (SELECT page_id, i, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS line FROM l)
       SELECT page_id, count(*)::BIGINT AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS content FROM s WHERE line <> '' GROUP BY 1""",
)
def markup_to_text(spark, base):
    pages = markup.legal_text(table(spark, base, "pages").select("page_id", "html"), "html")
    return pages.select(
        "page_id",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.md5("text").alias("content"),
    )


@query("page_personal_data")
def page_personal_data(spark, base):
    pages = markup.legal_text(table(spark, base, "pages").select("page_id", "html"), "html")
    detected = detect_personal_data(pages)
    return detected.select(
        "page_id", F.size("pii").cast("bigint").alias("n_findings"), "has_sensitive"
    )


# -- retrieval ------------------------------------------------------------------------


def _centroids(spark, base):
    """Mean vector per label: as many queries as there are labels."""
    vectors = table(spark, base, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = vectors.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(
            "query_vector"
        )
    )


@query(
    "nearest_to_label_centroids",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       q AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), qn AS (SELECT label, sqrt(sum(m*m)) AS n FROM q GROUP BY 1),
       vn AS (SELECT vec_id, sqrt(sum(x*x)) AS n FROM x GROUP BY 1),
       d AS (SELECT q.label, x.vec_id, sum(q.m * x.x) AS dp FROM q JOIN x USING (i) GROUP BY 1, 2),
       s AS (SELECT d.label, d.vec_id, round(dp / (qn.n * vn.n), 6) AS score FROM d JOIN qn USING (label) JOIN vn USING (vec_id)),
       r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
       SELECT label::BIGINT AS query_id, vec_id, rank::INT AS rank, round(score::DECIMAL(18, 6), 4)::DOUBLE AS score FROM r WHERE rank <= 5""",
)
def nearest_to_label_centroids(spark, base):
    corpus = table(spark, base, "embeddings").select("vec_id", "embedding")
    return R.nearest_vectors(corpus, _centroids(spark, base), k=5)


TFIDF_SQL = f"""WITH tok AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[{LETTER}]+')) AS w FROM documents
      UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[{LETTER}]+')) FROM benchmark),
    tf AS (SELECT side, id, ('0x' || substr(md5(w), 1, 4))::INT AS b, count(*) AS tf FROM tok GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents), df AS (SELECT b, count(*) AS df FROM tf WHERE side = 'd' GROUP BY 1),
    w AS (SELECT side, id, b, tf * ln((n.n + 1.0) / (coalesce(df.df, 0) + 1.0)) AS w FROM tf LEFT JOIN df USING (b), n),
    nm AS (SELECT side, id, sqrt(sum(w*w)) AS nm FROM w GROUP BY 1, 2),
    u AS (SELECT w.side, w.id, b, CASE WHEN nm > 0 THEN w / nm ELSE 0 END AS w FROM w JOIN nm USING (side, id))"""


@query(
    "passage_retrieval",
    TFIDF_SQL
    + """, s AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score
          FROM u q JOIN u d ON q.b = d.b AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, rank::INT AS rank, round(score::DECIMAL(18, 6), 4)::DOUBLE AS score FROM r WHERE rank <= 3""",
)
def passage_retrieval(spark, base):
    """For every benchmark passage the three most similar documents."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    queries = table(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.retrieve(docs, queries, "doc_id", k=3)


@query(
    "text_index",
    TFIDF_SQL
    + """ SELECT id AS doc_id, count(*)::BIGINT AS terms, round(sum(w), 4) AS weight FROM u WHERE side = 'd' GROUP BY 1""",
)
def text_index(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    index = R.build_text_index(docs, "doc_id")
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return index.select(
        "doc_id",
        F.size("buckets").cast("bigint").alias("terms"),
        F.round(total, 4).alias("weight"),
    )


@query(
    "cosine_to_own_centroid",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       q AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2)
       SELECT vec_id, round(sum(x.x * q.m) / sqrt(sum(x.x * x.x) * sum(q.m * q.m)), 6) AS similarity
       FROM x JOIN q USING (label, i) GROUP BY 1""",
)
def cosine_to_own_centroid(spark, base):
    vectors = table(spark, base, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("query_id"), "embedding"
    )
    joined = vectors.join(_centroids(spark, base), "query_id")
    sim = R.cosine(F.col("embedding"), F.col("query_vector"))
    return joined.select("vec_id", F.round(sim, 6).alias("similarity"))


# -- graph ------------------------------------------------------------------------------


def _with_range(orders):
    """One more column, the same in all rows: how far the numbers of orders reach."""
    return orders.join(F.broadcast(orders.agg((F.max("o_orderkey") + 1).alias("_m"))))


def articles(spark, base):
    """Orders as articles that mention two other orders (which may not exist)."""
    orders = _with_range(table(spark, base, "orders"))
    return orders.select(
        F.concat(F.lit("Art. "), F.col("o_orderkey").cast("string"), F.lit("º")).alias("article"),
        F.col("o_orderpriority").alias("tema"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("source"),
        F.expr(
            "concat('veja o Art. ', o_custkey * 3 + 1, 'º e o art ', (o_orderkey * 7) % _m, ' desta lei')"
        ).alias("text"),
    )


GRAPH_SQL = """WITH RECURSIVE m AS (SELECT o_orderkey AS a, o_custkey * 3 + 1 AS b FROM orders UNION ALL SELECT o_orderkey, (o_orderkey * 7) % (SELECT max(o_orderkey) + 1 FROM orders) FROM orders),
    e AS (SELECT DISTINCT 'art_' || a AS src, 'art_' || b AS dst FROM m WHERE a <> b AND b IN (SELECT o_orderkey FROM orders)),
    u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


@query("article_edges", GRAPH_SQL + " SELECT src, dst, 'menciona' AS relation FROM e")
def article_edges(spark, base):
    return G.mention_edges(articles(spark, base))


@query(
    "article_graph_size",
    GRAPH_SQL + " SELECT (SELECT count(*) FROM orders)::BIGINT AS node_count, (SELECT count(*) FROM e)::BIGINT AS edge_count",
)
def article_graph_size(spark, base):
    corpus = articles(spark, base)
    return G.graph_size(G.article_nodes(corpus), G.mention_edges(corpus))


@query(
    "related_articles",
    GRAPH_SQL
    + """, h1 AS (SELECT src, dst AS id FROM u), h2 AS (SELECT DISTINCT h1.src, u.dst AS id FROM h1 JOIN u ON h1.id = u.src WHERE h1.src <> u.dst)
        SELECT src, id, 1 AS distance FROM h1 UNION ALL
        SELECT src, id, 2 FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.src = h2.src AND h1.id = h2.id)""",
)
def related_articles(spark, base):
    """Everything within two hops, for every article at once."""
    corpus = articles(spark, base)
    return G.find_related(G.mention_edges(corpus), G.article_nodes(corpus), 2)


@query(
    "affected_articles",
    GRAPH_SQL
    + """ SELECT u.src AS changed, 'Art. ' || substr(u.dst, 5) || 'º' AS article FROM u
          JOIN orders ON u.src = 'art_' || o_orderkey WHERE o_orderpriority = '1-URGENT'""",
)
def affected_articles(spark, base):
    """Articles one mention away from each changed one (here: those of urgent orders)."""
    corpus = articles(spark, base)
    changed = table(spark, base, "orders").filter("o_orderpriority = '1-URGENT'")
    numbers = changed.select(F.col("o_orderkey").alias("number"))
    return W.affected_articles(G.article_nodes(corpus), G.mention_edges(corpus), numbers)


@query(
    "shortest_article_paths",
    GRAPH_SQL
    + """, w AS (SELECT src, src AS at, [src] AS path FROM (SELECT DISTINCT src FROM e) UNION ALL
          SELECT w.src, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON w.at = e.src WHERE len(w.path) <= 4),
        t AS (SELECT 'art_' || o_orderkey AS src, 'art_' || ((o_orderkey * 49) % (SELECT max(o_orderkey) + 1 FROM orders)) AS dst FROM orders),
        r AS (SELECT t.src, t.dst, path, row_number() OVER (PARTITION BY t.src, t.dst ORDER BY len(path), path) AS rn
          FROM t JOIN w ON w.src = t.src AND w.at = t.dst)
        SELECT src, dst, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM r WHERE rn = 1""",
)
def shortest_article_paths(spark, base):
    """From every article to one fixed other, at most four mentions away."""
    corpus = articles(spark, base)
    edges = cut_lineage(G.mention_edges(corpus))
    # Articles without mentions start no path.
    pairs = _with_range(table(spark, base, "orders")).select(
        F.expr("concat('art_', o_orderkey)").alias("src"),
        F.expr("concat('art_', (o_orderkey * 49) % _m)").alias("dst"),
    ).join(edges.select("src").distinct(), "src", "left_semi")
    out = G.shortest_paths(edges, pairs, max_hops=4)
    return out.select("src", "dst", F.array_join("path", ">").alias("path"), "hops")


def _wide_articles(spark, base):
    """Orders as articles that mention two other orders, spread over all of them."""
    orders = _with_range(table(spark, base, "orders"))
    number = F.col("o_orderkey").cast("string")
    return orders.select(
        F.concat(F.lit("Art. "), number, F.lit("º")).alias("article"),
        F.expr(
            "concat('veja o Art. ', (o_orderkey * 31 + o_custkey * 7 + 1) % _m, 'º e o art ', (o_orderkey * 7 + 3) % _m, ' desta lei')"
        ).alias("text"),
        F.concat(F.lit("art_"), number).alias("src"),
        F.expr("concat('art_', (o_orderkey * 49 + 5) % _m)").alias("dst"),
    )


@query("shortest_article_paths_of_any_length")
def shortest_article_paths_of_any_length(spark, base):
    """From every article to one fixed other, both anywhere in the table, however many mentions away."""
    corpus = _wide_articles(spark, base)
    out = G.shortest_paths(G.mention_edges(corpus), corpus.select("src", "dst"))
    return out.select("src", "dst", F.array_join("path", ">").alias("path"), "hops")


CUSTOMERS_PER_TASK = 20_000


@query("synthetic_customers")
def synthetic_customers(spark, base):
    """A made-up identity for every customer, checked by the detector."""
    keys = table(spark, base, "customer").select("c_custkey")
    # A file of keys is few row groups, however many rows: dealt by rows, each a small part of a task.
    parts = max(spark.sparkContext.defaultParallelism, -(-keys.count() // CUSTOMERS_PER_TASK))
    people = with_person(keys.repartition(parts), F.col("c_custkey"), 42)
    text = F.concat_ws(", ", F.lit("cliente"), "cpf", "email", "phone")
    detected = detect_personal_data(people.withColumn("text", text))
    return detected.select(
        "c_custkey", "name", "cpf", "email", "phone", F.size("pii").cast("bigint").alias("found")
    )
