"""Benchmark decontamination with a stored positional inverted index.

Documents are read once: the postings (document, position) of every term that
occurs in a benchmark are written as a table, with one header row per document.
No other posting can ever take part in a match. Each benchmark window is then
looked up from its rarest term: the list of that term, moved by its place in
the item, is intersected with the list of the next rarest, and what is left
with the lists of all other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlattice.functions.scale import pin
from govlattice.llm.common import ascii_lower, broadcast_if_small, fresh_folder
from govlattice.session import cut_lineage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_words(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """A row per benchmark word: ``_item``, ``_ipos``, ``_size`` (words of the item), ``_word``.

    Equal ids with other texts are told apart while matching by ``_item``, a
    struct of id and text hash.
    """
    rows = items.select(
        F.struct(
            F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("id"),
            F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("h"),
        ).alias("_item"),
        F.col(text_column).alias("_text"),
    ).dropDuplicates(["_item"])
    rows = pin(rows, "_w", words_of(F.col("_text"))).drop("_text")
    return rows.select("_item", F.size("_w").alias("_size"), F.posexplode("_w").alias("_ipos", "_word"))


def write_index(docs: DataFrame, vocabulary: DataFrame, id_column: str, text_column: str, folder: str) -> DataFrame:
    """Write the postings of the vocabulary (``_word``, ``_term``) and a header row per document.

    Columns: ``_id``, ``_doc`` (number of the row), ``_term``, ``_pos``. Headers
    have term 0 and the number of words as position.
    """
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.monotonically_increasing_id().alias("_doc"),
        F.col(text_column).alias("_text"),
    )
    rows = pin(rows, "_w", words_of(F.col("_text"))).drop("_text")
    # Behind the last word stands an empty one, the header.
    words = rows.select("_id", "_doc", F.posexplode(F.concat("_w", F.array(F.lit("")))).alias("_pos", "_word"))
    known = broadcast_if_small(vocabulary)
    words.join(known, "_word").select("_id", "_doc", "_term", "_pos").write.option("compression", "zstd").parquet(
        folder
    )
    return docs.sparkSession.read.parquet(folder)


def _window_anchors(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Per window its rarest and next rarest place: ``_item``, ``_first``, ``_size``, and two (term, ipos).

    Windows with a term that no document has are left out: they cannot occur.
    """
    width = F.least(F.lit(window), F.col("_size"))
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("_ipos") - width + 1), F.least(F.col("_ipos"), F.col("_size") - width)
    )
    ranked = words.join(counts, "_term", "left").select(
        "_item", "_size", F.explode(starts).alias("_first"), F.struct("_n", "_term", "_ipos").alias("_place")
    )
    per_window = ranked.groupBy("_item", "_size", "_first").agg(
        F.sort_array(F.collect_list("_place")).alias("_places")  # at most ``window`` of them
    )
    return per_window.filter(F.get("_places", F.lit(0))["_n"].isNotNull()).select(
        "_item",
        "_size",
        "_first",
        F.get("_places", F.lit(0)).alias("_a"),
        F.coalesce(F.get("_places", F.lit(1)), F.get("_places", F.lit(0))).alias("_b"),
    )


def _aligned(index: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Items laid over documents where the two rarest terms of some window fit.

    ``_item``, ``_size``, ``_doc``, ``_shift`` (place of the item's first word
    in the document) and the range ``_lo``, ``_hi`` of item words to look at.
    """
    width = F.least(F.lit(window), F.col("_size"))
    small = broadcast_if_small(
        anchors.select(
            "_item", "_size", "_first", F.col("_a._term").alias("_term"), F.col("_a._ipos").alias("_at"),
            F.col("_b._term").alias("_term2"), (F.col("_b._ipos") - F.col("_a._ipos")).alias("_step"),
        )
    )
    found = index.select("_doc", "_term", "_pos").join(small, "_term")
    found = found.groupBy("_doc", F.col("_term2").alias("_term"), (F.col("_pos") + F.col("_step")).alias("_pos"),
                          "_item", "_size", (F.col("_pos") - F.col("_at")).alias("_shift")).agg(
        F.min("_first").alias("_lo"), F.max(F.col("_first") + width).alias("_hi")
    )
    second = broadcast_if_small(anchors.select(F.col("_b._term").alias("_term")).distinct())
    lists = index.select("_doc", "_term", "_pos").join(second, "_term", "left_semi")
    both = found.join(lists, ["_doc", "_term", "_pos"])
    return both.groupBy("_item", "_size", "_doc", "_shift").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def match_windows(index: DataFrame, words: DataFrame, window: int = 13) -> DataFrame:
    """Occurrences of windows: ``_item``, ``_doc``, ``_from``, ``_to`` (document words, end excluded)."""
    counts = index.filter("_term > 0").groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    anchors = cut_lineage(_window_anchors(words, counts, window))
    placed = _aligned(index.filter("_term > 0"), anchors, window)
    # All other terms: a row for each word to be found, none for items that fit nowhere.
    wanted = placed.select(
        "_item", "_size", "_doc", "_shift", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("_ipos")
    ).join(broadcast_if_small(words.select("_item", "_ipos", "_term")), ["_item", "_ipos"])
    wanted = wanted.withColumn("_pos", F.col("_shift") + F.col("_ipos"))
    fit = wanted.join(index.select("_doc", "_pos", "_term"), ["_doc", "_pos", "_term"])
    runs = fit.groupBy("_item", "_size", "_doc", "_shift").agg(F.sort_array(F.collect_list("_ipos")).alias("_p"))
    runs = runs.withColumn("_width", F.least(F.lit(window), F.col("_size")))
    firsts = F.filter("_p", lambda p, k: F.get("_p", k + F.col("_width") - 1) == p + F.col("_width") - 1)
    starts = F.transform(firsts, lambda p: p + F.col("_shift"))
    return runs.select("_item", "_doc", "_width", F.explode(starts).alias("_from")).select(
        "_item",
        "_doc",
        F.col("_from").cast("bigint").alias("_from"),
        (F.col("_from") + F.col("_width")).cast("bigint").alias("_to"),
    )


def near_terms(index: DataFrame, first: int, second: int, within: int) -> DataFrame:
    """Proximity: (``_doc``, ``_pos``, ``_pos2``) of two terms at most ``within`` words apart, in any order.

    The lists are joined on the document and on blocks of ``within`` positions,
    so a document's list is never paired with another as a whole.
    """
    block = F.floor(F.col("_pos") / within)
    a = index.filter(F.col("_term") == first).select("_doc", "_pos", F.explode(F.array(block - 1, block, block + 1)).alias("_b"))
    b = index.filter(F.col("_term") == second).select("_doc", F.col("_pos").alias("_pos2"), block.alias("_b"))
    near = F.abs(F.col("_pos") - F.col("_pos2")) <= within
    return a.join(b, ["_doc", "_b"]).filter(near).select("_doc", "_pos", "_pos2")


def _covered(ranges: Column) -> Column:
    """Number of positions in the union of ranges sorted by (start, end)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    return F.aggregate(
        ranges,
        zero,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), r["_to"] - F.greatest(r["_from"], a["end"]))).alias("n"),
            F.greatest(a["end"], r["_to"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 13,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids as strings), contaminated.

    A document is contaminated if at least a twentieth of its words lie in
    windows of benchmark items. Null texts have no words and are clean; items
    without words match nothing; a null item id counts as the empty string.
    Documents are judged row by row, whatever their ids; repeated items count
    once. Empty tables give no rows, or clean ones. Other columns are not read.
    """
    spark = docs.sparkSession
    words = cut_lineage(item_words(items, item_column, item_text_column))
    terms = words.select("_word").distinct().withColumn("_term", F.row_number().over(Window.orderBy("_word")))
    header = spark.range(1).select(F.lit("").alias("_word"), F.lit(0).alias("_term"))
    vocabulary = cut_lineage(terms.unionByName(header))
    words = words.join(broadcast_if_small(vocabulary), "_word").drop("_word")
    index = write_index(docs, vocabulary, id_column, text_column, fresh_folder(spark, "postings"))
    hits = match_windows(index, words, window)
    per_doc = hits.groupBy("_doc").agg(
        F.sort_array(F.collect_set(F.struct("_from", "_to"))).alias("_ranges"),
        F.sort_array(F.collect_set("_item.id")).alias("items"),
    )
    per_doc = per_doc.select("_doc", "items", _covered(F.col("_ranges")).alias("n_hit"))
    heads = index.filter("_term = 0").select("_id", "_doc", F.col("_pos").cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return heads.join(per_doc, "_doc", "left").select(
        F.col("_id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([] if id_column == "_doc" else [F.col("_doc").alias("row_no")]),
    )
