"""Token ids of whole texts, stored as Parquet that can be read selectively.

Texts are encoded by the ``tokenizers`` library. Its pre-tokenizer never joins
characters across ASCII white space, so the words between white space are
encoded once per process and looked up afterwards; words of Latin-1 characters
go straight to the library's model, all others through its whole pipeline.

The files are Spark's own Parquet: one list column of ids per document with
dictionary or delta encoding, a set row-group size, and page indexes, next to
narrow columns (length, place in the file) that are read without the ids.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Collection, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlattice.llm.common import broadcast_if_small, fresh_folder, list_of, per_process, slices, utf8_parts

# Words remembered by a process; beyond it the table starts anew.
MOST_WORDS = 1_500_000
# Frequent words looked up first, in a table that a processor's cache holds.
NEAR_WORDS = 4_096
# Not UTF-8, so no text holds it.
BETWEEN = b"\xff"
# Text encoded in one step.
SLICE_BYTES = 2 << 20


class WordEncoder:
    """Encodes texts word by word; ``path`` is a tokenizers file whose words end at white space.

    The ids of all known words lie in one array. A text is then the places of
    its words in it, and its ids are gathered from there.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The pre-tokenizer's pattern, for lower-case Latin-1, and its bytes as letters. Fixed values.
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
        self.odd = re.compile(r"[^!-~À-ÖØ-öø-ÿ\n]|<\|").finditer
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.near: dict[bytes, int] = {}  # the frequent ones of them
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def _learn(self, words: Sequence[bytes], end: int) -> None:
        """Encode words: Latin-1 ones piece by piece with the model, others by the whole tokenizer."""
        tokenize, pieces, letters = self.tokenizer.model.tokenize, self.pieces, self.letters
        joined = b"\n".join(words).decode("utf-8", "replace")
        texts = joined.split("\n")
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = np.array([m.start() for m in self.odd(joined)], np.int64)
        later = np.unique(np.searchsorted(ends, found, "right")).tolist()
        odd = set(later)
        ids, sizes = [], []
        marks: dict[str, list[int]] = {}  # pieces that are no words: few, and met all the time
        for at, low in enumerate(joined.lower().split("\n")):
            before = len(ids)
            if at in odd:
                pass
            elif low.isalpha():
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(letters)
                ids += [t.id for t in tokenize(low)]
            else:
                for piece in pieces(low):
                    if len(piece) < 3:
                        if piece not in marks:
                            raw = piece.encode().decode("latin-1").translate(letters)
                            marks[piece] = [t.id for t in tokenize(raw)]
                        ids += marks[piece]
                        continue
                    if not piece.isascii():
                        piece = piece.encode().decode("latin-1").translate(letters)
                    ids += [t.id for t in tokenize(piece)]
            sizes.append(len(ids) - before)
        known = [w for at, w in enumerate(words) if at not in odd]
        sizes = [n for at, n in enumerate(sizes) if at not in odd]
        if later:
            encoded = self.tokenizer.encode_batch([texts[i] for i in later], add_special_tokens=False)
            for i, e in zip(later, encoded):
                # The word that ends each text is not UTF-8, so it is among the odd ones.
                own = [end] if words[i] == BETWEEN else e.ids
                known.append(words[i])
                ids += own
                sizes.append(len(own))
        self.place.update(zip(known, range(len(self.place), len(self.place) + len(known))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])

    def encode(self, texts: Sequence[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and how many each has."""
        if self.place.get(BETWEEN) is not None and self.ids[self.bounds[self.place[BETWEEN]]] != end:
            self._clear()
        # A word that no text can hold stands for the end of each.
        words = (b" " + BETWEEN + b" ").join([*texts, b""]).split()
        places = np.fromiter(map(self.near.get, words, itertools.repeat(-1)), np.int64, len(words))
        far = np.flatnonzero(places < 0)
        others = map(words.__getitem__, far.tolist())
        places[far] = np.fromiter(map(self.place.get, others, itertools.repeat(-1)), np.int64, len(far))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = {words[i] for i in missing.tolist()}
            if len(self.place) + len(new) > MOST_WORDS:
                self._clear()
                new, missing = set(words), np.arange(len(words))
            self._learn(list(new), end)
            places[missing] = [self.place[words[i]] for i in missing.tolist()]
            if not self.near:
                # Copies lie close together in memory, which is what makes this table fast.
                common = Counter(words).most_common(NEAR_WORDS)
                self.near = {bytes(bytearray(w)): self.place[w] for w, _ in common}
        begins, lengths = self.bounds[places], self.bounds[places + 1] - self.bounds[places]
        after = np.cumsum(lengths)
        ids = self.ids[np.arange(len(words) and after[-1]) + np.repeat(begins - after + lengths, lengths)]
        last = places == self.place.get(BETWEEN, -1)
        return ids, np.diff(after[last], prepend=0)


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process."""
    return per_process(f"words of {path}", lambda: WordEncoder(path))


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2_000,
) -> str:
    """Encode every whole text and write ids in ascending order of the id column.

    Files hold contiguous ranges of ids in order; a document never spans two.
    Columns: the id, ``n_tokens``, ``offset_in_file`` (ids of the documents
    before it in the file), ``file_no`` and ``tokens``. ``encoding`` is
    "dictionary" (ids of a file as positions in its dictionary) or "delta"
    (binary packed differences).

    Null texts are empty and give just the end id. Equal ids keep all their
    rows (ordered by text); null ids come first. An empty table gives empty
    files; other columns are not read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be dictionary or delta")
    rows = (
        docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id", "_text")
    )
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches):
        from pyspark import TaskContext

        words, before, part = word_encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "_text", SLICE_BYTES):
            ids, lengths = words.encode(list(utf8_parts(batch.column(1))), end)
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths),
                    pa.array(starts),
                    pa.array(np.full(len(lengths), part, np.int32)),
                    list_of(ids, lengths, pa.int32()),
                ],
                ["_id", "n_tokens", "offset_in_file", "file_no", "tokens"],
            )

    out = rows.mapInArrow(
        work, f"_id {kind}, n_tokens bigint, offset_in_file bigint, file_no int, tokens array<int>"
    ).withColumnRenamed("_id", id_column)
    leaf = "tokens.list.element"
    (
        out.write.option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.writer.version", "PARQUET_2_0")
        .option(f"parquet.enable.dictionary#{leaf}", str(encoding == "dictionary").lower())
        .option("compression", "zstd")
        .mode("errorifexists")
        .parquet(folder)
    )
    return folder


def read_token_files(
    spark: SparkSession, folder: str, *, id_column: str = "doc_id", tokens: bool = True
) -> DataFrame:
    """Documents of :func:`write_token_files` with ``start``, the ids of all documents before them.

    The totals per file come from the narrow columns alone; without ``tokens``
    the list column is never read. There is one total per file, so the running
    sum over them is small; it is broadcast only if it is.
    """
    files = spark.read.parquet(folder)
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    kept = [id_column, "file_no", "offset_in_file", "n_tokens", *(["tokens"] if tokens else [])]
    joined = files.select(*kept).join(broadcast_if_small(bases), "file_no")
    start = (F.col("_base") + F.col("offset_in_file")).alias("start")
    return joined.select(id_column, start, "n_tokens", *(["tokens"] if tokens else []))


def with_crc32(df: DataFrame, tokens: str = "tokens", name: str = "ids_crc32") -> DataFrame:
    """Replace a list of ids by the crc32 of its little-endian 32-bit values."""
    kept = [c for c in df.columns if c != tokens]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]

    def work(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(tokens))
            values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            offsets = np.asarray(column.offsets).astype(np.int64) * 4
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums, pa.int64())], [*kept, name])

    return df.select(*kept, tokens).mapInArrow(work, ", ".join([*fields, f"`{name}` bigint"]))


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files into a fresh shared folder and read the digest back from them."""
    spark = docs.sparkSession
    folder = write_token_files(docs, fresh_folder(spark, "tokens"), tokenizer, **options)
    return with_crc32(read_token_files(spark, folder))
