"""Removal of repeated lines, with levelled sorted runs of line hashes.

Documents come in batches of falling ids. The runs hold each hash that was seen
so far exactly once, bucketed and sorted by hash: a batch's hashes are
anti-joined against every run without moving the runs, and what is left - the
lines that no larger id has - becomes a run of its own. So the row of a hash in
the runs names the document that keeps its lines. Hashes already in the runs
only add to a count. When a level has ``fan`` runs, they are merged into one of
the next level, so a batch meets a logarithmic number of runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.llm.common import ascii_lower, fresh_folder
from govlattice.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
# Hashes with more than this part of all occurrences are joined by broadcast; there are at most as many of them.
HOT = 4_096


def line_key(line: Column) -> Column:
    """What two lines are compared by: no white space at the ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class Runs:
    """Levelled sorted runs: ``h``, and the other columns of the first row that came with it."""

    def __init__(self, spark: SparkSession, fan: int = 2):
        self.spark, self.fan = spark, fan
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(buckets, "h").write.bucketBy(buckets, "h").sortBy("h")
        dealt.option("path", fresh_folder(self.spark, "run")).saveAsTable(name)
        self.written += 1
        return name, self.spark.table(name)

    def _forget(self, runs: list[tuple[str, DataFrame]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    @property
    def all(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Rows whose hash is in no run: one merge anti-join with each."""
        for run in self.all:
            rows = rows.join(run.select("h").hint("merge"), "h", "left_anti")
        return rows

    def add(self, rows: DataFrame) -> None:
        """Add rows with hashes that are in no run, and compact full levels."""
        run, level = self._write(rows), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan:
                return
            old, self.levels[level] = self.levels[level], []
            # Runs share no hash, so a merged run is theirs sorted together.
            merged = old[0][1]
            for _, df in old[1:]:
                merged = merged.unionByName(df)
            run, level = self._write(merged), level + 1
            self._forget(old)

    def rows(self) -> DataFrame:
        runs = self.all
        out = runs[0]
        for df in runs[1:]:
            out = out.unionByName(df)
        return out

    def close(self) -> None:
        """Take the runs out of the catalogue; written results stay."""
        for level in self.levels:
            self._forget(level)
        self.levels = []


def _batches(rows: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """``batch``: ranges of falling ids with about as many documents each; null ids come last."""
    value = F.col("_id").cast("double")
    parts = [k / batches for k in range(1, batches)]
    found = rows.agg(F.percentile_approx(value, parts, 1_000).alias("v")).first()["v"] if parts else None
    borders = sorted(set(found or []), reverse=True)
    number = F.lit(len(borders))
    for k, border in reversed(list(enumerate(borders))):
        number = F.when(value >= border, k).otherwise(number)
    return rows.withColumn("batch", number), len(borders) + 1


def _occurrences(rows: DataFrame, least_chars: int) -> DataFrame:
    """``h``, ``_id``, ``_k``, ``batch``, ``at``: each long line of each document once, with its places."""
    lines = rows.select("_id", "_k", "batch", F.posexplode(F.split("_text", "\n", -1)).alias("at", "line"))
    keyed = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= least_chars)
    hashed = keyed.select(F.unhex(F.md5("line")).alias("h"), "_id", "_k", "batch", "at")
    return hashed.groupBy("h", "_id", "_k", "batch").agg(F.collect_set("at").alias("at"))


def _lost(occurrences: DataFrame, frequent: DataFrame) -> DataFrame:
    """``_id``, ``_k``, ``gone``: places of frequent lines outside the document that keeps them.

    Hashes that make up more than a 4,096th of all occurrences are at most
    4,096, so they can be broadcast; no task has to take all rows of one.
    """
    everything = occurrences.agg(F.count(F.lit(1)).alias("all"))
    hot = frequent.join(F.broadcast(everything)).filter(F.col("n") * HOT > F.col("all"))
    hot = F.broadcast(hot.select("h", F.struct("top").alias("hot")))
    seen = occurrences.join(hot, "h", "left")
    common = seen.filter("hot is not null").select("_id", "_k", "at", "hot.top")
    other = seen.filter("hot is null").join(frequent, "h").select("_id", "_k", "at", "top")
    lost = common.unionByName(other).filter(~F.col("_id").eqNullSafe(F.col("top")))
    return lost.groupBy("_id", "_k").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("gone"))


def repeated_lines(
    rows: DataFrame,
    *,
    least_chars: int,
    least_docs: int,
    batches: int,
    watch: Callable[[Runs], None] | None = None,
) -> DataFrame:
    """``_id``, ``_k``, ``gone``: places of the lines that documents (``_id``, ``_k``, ``_text``) lose."""
    spark = rows.sparkSession
    numbered, count = _batches(rows, batches)
    folder = fresh_folder(spark, "lines")
    found = _occurrences(numbered, least_chars)
    found.write.partitionBy("batch").parquet(folder)
    occurrences = spark.read.schema(found.schema).parquet(folder)

    runs = Runs(spark)
    again = []
    for number in range(count):
        batch = occurrences.filter(F.col("batch") == number)
        own = cut_lineage(batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("top")))
        fresh = cut_lineage(runs.fresh(own))
        again.append(own.join(fresh.select("h"), "h", "left_anti").select("h", "n"))
        runs.add(fresh)
        if watch:
            watch(runs)
    more = again[0]
    for df in again[1:]:
        more = more.unionByName(df)
    more = more.groupBy("h").agg(F.sum("n").alias("more"))
    known = runs.rows().join(more, "h", "left")
    known = known.select("h", "top", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    frequent = cut_lineage(known.filter(F.col("n") >= least_docs))
    runs.close()
    return _lost(occurrences, frequent)


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = 20,
    least_docs: int = 3,
    batches: int = 4,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, carried columns, ``n_lines``, ``n_dropped`` and the ``kept`` text.

    Lines are what lies between line feeds; null and empty texts are one empty
    line. Lines whose key has ``least_chars`` code points and is found in
    ``least_docs`` documents stay only in the documents with the largest id that
    has it (all its rows; all their lines). Ids are numbers; a null id is the
    smallest. Rows with equal id and text count as one document and are treated
    alike. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_k"), text.alias("_text"))
    lost = repeated_lines(rows, least_chars=least_chars, least_docs=least_docs, batches=batches)
    whole = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_column, *carry])]).alias("_row")
    texts = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_k"), text.alias("_text"), whole)
    lost = lost.withColumnsRenamed({"_id": "_id2", "_k": "_k2"})
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_k") == F.col("_k2"))
    cut = texts.join(lost, same, "left").select(
        "_row", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("_gone")
    )
    # What is kept lies between one lost place and the next.
    borders = F.concat(F.array(F.lit(-1)), F.col("_gone"))
    between = F.transform(
        borders,
        lambda a, i: F.slice(
            "_lines", a + 2, F.coalesce(F.get("_gone", i), F.size("_lines")) - a - 1
        ),
    )
    return cut.select(
        "_row.*",
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size("_gone").cast("bigint").alias("n_dropped"),
        F.array_join(F.flatten(between), "\n").alias("kept"),
    )
