"""Text files: regulatory corpus, front matter, document scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.functions.text import strip
from govlattice.operators.personal_data import detect_personal_data
from govlattice.session import bounded_rows

TEXT_EXTENSIONS = ("txt",)
# Fixed value: the note line that is left out when a chunk is indexed.
DISCLAIMER = "# Resumo ilustrativo"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.txt`` of a folder, one row per file; a missing folder is empty."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "source STRING, raw STRING")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("raw"))


def split_front_matter(raw: Column) -> tuple[Column, Column]:
    """Header entries (key lower-cased, last one wins) and body of a text.

    The header ends at the first blank line; a text without a body is its own
    body.
    """
    at = F.instr(raw, "\n\n")
    header = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw)
    rest = F.when(at > 0, F.substring(raw, at + 2, F.length(raw))).otherwise("")
    lines = F.filter(F.split(header, r"\r\n|[\n\r]"), lambda l: F.instr(l, ":") > 0)

    def entry(line: Column) -> Column:
        colon = F.instr(line, ":")
        return F.struct(
            F.lower(strip(F.substring(line, F.lit(1), colon - 1))).alias("key"),
            strip(F.substring(line, colon + 1, F.length(line))).alias("value"),
        )

    entries = F.transform(lines, entry)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]
        ),
    )
    body = strip(rest)
    return F.map_from_entries(last), F.when(body == "", strip(raw)).otherwise(body)


def parse_corpus(files: DataFrame, raw: str = "raw") -> DataFrame:
    """``source, article, tema, text`` of corpus files."""
    meta, body = split_front_matter(F.col(raw))
    out = files.withColumn("_meta", meta).withColumn("text", body)

    def field(name: str) -> Column:
        value = F.try_element_at("_meta", F.lit(name))
        return F.when(value != "", value)

    return out.select(
        "source", field("artigo").alias("article"), field("tema").alias("tema"), "text"
    )


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return parse_corpus(read_text_corpus(spark, folder))


def indexing_text(text: Column, tema: Column) -> Column:
    """Text a chunk is indexed by: topic first, disclaimer lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda l: ~strip(l).startswith(DISCLAIMER))
    body = strip(F.array_join(lines, "\n"))
    return strip(F.concat(F.coalesce(tema, F.lit("")), F.lit("\n\n"), body))


def chunk_id(position: Column, article: Column) -> Column:
    slug = F.regexp_replace(F.coalesce(article, F.lit("na")), "[ º]", "")
    number = F.lpad(position.cast("string"), 3, "0")
    wide = F.when(F.length(position.cast("string")) > 3, position.cast("string")).otherwise(number)
    return F.concat(F.lit("chunk-"), wide, F.lit("-art"), slug)


def scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scan text documents; returns (results, rejects).

    Bytes that are not UTF-8 are replaced. Files of another kind are rejected
    by name, before their bytes are read.
    """
    names = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract(F.col("path"), r"\.([^./\\]+)$", 1))
    file_name = F.regexp_extract(F.col("path"), r"([^/\\]+)$", 1)
    known = extension.isin(*TEXT_EXTENSIONS)
    rejects = names.filter(~known).select(
        file_name.alias("file_name"), F.lit("unsupported_extension").alias("reason")
    )
    text = names.filter(known).select(
        file_name.alias("file_name"),
        extension.alias("file_type"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
    results = detect_personal_data(text).select(
        "file_name",
        "file_type",
        F.lit(1).alias("pages_scanned"),
        F.length("text").alias("characters_extracted"),
        "pii",
        "has_sensitive",
        F.lit("").alias("extraction_notes"),
    )
    return results, rejects


def missing_paths(spark: SparkSession, wanted: DataFrame, path: str = "path") -> list[str]:
    """Of a short list of paths, those that do not exist."""
    return [r[path] for r in bounded_rows(wanted, 10_000, "paths") if not path_exists(spark, r[path])]
