"""Every operator against its plain version over odd texts, and on empty tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from govlattice.llm import decontamination, packing, quality, repeats, simhash, tokens
from govlattice.llm.components import connected_components

from . import plain
from .conftest import documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("_text", "_id", "m", "f", "tokens", "kept", "n_words", "length")


def rows(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, encoding, tmp_path):
    docs = documents(spark, odd, CLASH)
    folder = tokens.write_token_files(docs, str(tmp_path / "t"), TOKENIZER, end=2, encoding=encoding)
    got = tokens.read_token_files(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in got) == Counter(
        (i, tuple(plain.ids_of(t, 2))) for i, t in odd
    )
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    digest = tokens.with_crc32(tokens.read_token_files(spark, folder))
    assert rows(digest, "doc_id", "ids_crc32") == Counter((i, plain.crc(plain.ids_of(t, 2))) for i, t in odd)
    narrow = tokens.read_token_files(spark, folder, tokens=False)
    assert "tokens" not in narrow.columns and narrow.count() == len(odd)


def test_token_files_encodings(spark, odd, tmp_path):
    import pyarrow.parquet as pq

    for encoding, wanted in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        folder = tmp_path / encoding
        tokens.write_token_files(documents(spark, odd * 5), str(folder), TOKENIZER, encoding=encoding)
        file = pq.ParquetFile(max(folder.glob("*.parquet"), key=lambda p: p.stat().st_size))
        column = file.metadata.row_group(0).column(4)
        assert "tokens" in column.path_in_schema and wanted in column.encodings
        assert file.metadata.row_group(0).column(0).has_offset_index


def test_word_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    words = tokens.WordEncoder(TOKENIZER)
    for text in ("a b c", "d e", "a b c d e f g", "g h"):
        ids, sizes = words.encode([text.encode(), b"", b"a"], 7)
        assert ids.tolist() == [*plain.ids_of(text, 7), 7, *plain.ids_of("a", 7)] and sizes.tolist()[1] == 1


def test_packing(spark, odd):
    docs = documents(spark, [*odd, *[(100 + i, "word " * (i % 9)) for i in range(60)]], CLASH)
    packed = packing.pack_documents(docs, TOKENIZER, end=1, capacity=64, tokens=True)
    got = packed.collect()
    by_doc = Counter()
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = plain.ids_of(t, 1)
        for k, a in enumerate(range(0, len(ids), 64)):
            by_doc[i, k, a, len(ids[a : a + 64]), plain.crc(ids[a : a + 64])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == by_doc
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.1 * -(-total // 64) + 1
    whole = packing.packed_sequences(packed).collect()
    assert sum(len(r["tokens"]) for r in whole) == total


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.integers(4, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
        free: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [i for i, room in enumerate(free) if room >= length]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= length
            else:
                free.append(capacity - length)
        runs = packing.best_fit_plan(dict(Counter(lengths)), capacity)
        used, ranks = defaultdict(list), defaultdict(int)
        for length, lo, hi, first, each, offset in sorted(runs):
            assert lo == ranks[length]
            ranks[length] = hi
            for i in range(hi - lo):
                used[first + i // each].append((offset + i % each * length, length))
        assert ranks == Counter(lengths) and len(used) == len(free)
        rooms = []
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            rooms.append(capacity - at)
        assert sorted(rooms) == sorted(free)


def test_quality(spark, odd):
    judged = quality.judge_quality(documents(spark, odd, CLASH), sample_rows=20)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows(judged, "doc_id", *names) == Counter((i, *plain.quality(t)) for i, t in odd)
    assert judged.filter("kept <> (rejected_by is null)").count() == 0
    docs = documents(spark, odd, CLASH)
    kept = quality.keep_good(docs, sample_rows=20)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text", "kept") == Counter((i, t, "x") for i, t in odd if plain.quality(t)[-1])


def test_quality_of_a_long_text_with_many_repeats(spark):
    text = " ".join(f"w{i % 5000}" for i in range(12_000)) + " " + " ".join(f"u{i}" for i in range(3000))
    judged = quality.judge_quality(documents(spark, [(1, text)]))
    assert judged.first()["n_repeat_words"] == plain.quality(text)[4]


def test_quality_is_native(spark, odd):
    plan = quality.judge_quality(documents(spark, odd))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def benchmark(spark, odd):
    texts = dict(odd)
    words = texts[8].split(" ")
    items = [
        (0, " ".join(texts[13].split(" ")[3:40])),
        (1, " ".join(words[10:23])),
        (2, "never seen words of an item that no document has at all in any place"),
        (3, "one two"),
        (4, None),
        (5, ""),
        (5, "a b c d"),
        (None, texts[7]),
        (1, " ".join(words[10:23])),
        (10, "la la la la la la la la la la la la la la"),
    ]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination(spark, odd):
    items, table = benchmark(spark, odd)
    more = [*odd, (70, "ONE, two! " + "far apart " * 30), (71, "one\x00two 3 " * 3)]
    found = decontamination.find_contamination(documents(spark, more, CLASH), table)
    got = found.select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated"
    )
    assert Counter(map(tuple, got.collect())) == Counter(plain.contamination(more, items))


def test_decontamination_of_empty_tables(spark, odd):
    items, table = benchmark(spark, odd)
    assert decontamination.find_contamination(documents(spark, []), table).count() == 0
    clean = decontamination.find_contamination(documents(spark, odd), table.limit(0))
    assert clean.count() == len(odd) and clean.filter("contaminated or n_hit > 0").count() == 0


def test_near_terms(spark):
    docs = documents(spark, [(1, "a x x b x a"), (2, "b a"), (3, "a x x x x b")])
    vocabulary = spark.createDataFrame([("", 0), ("a", 1), ("b", 2)], "_word string, _term int")
    folder = decontamination.fresh_folder(spark, "test")
    index = decontamination.write_index(docs, vocabulary, "doc_id", "text", folder)
    near = decontamination.near_terms(index, 1, 2, 3).join(index.filter("_term = 0").select("_doc", "_id"), "_doc")
    assert rows(near, "_id", "_pos", "_pos2") == Counter([(1, 0, 3), (1, 5, 3), (2, 1, 0)])


def test_near_duplicates(spark, odd):
    got = simhash.near_duplicates(documents(spark, odd, CLASH))
    prints = [plain.simhash(t) for _, t in odd]
    first = plain.groups(prints)
    least = {}
    for (i, _), g in zip(odd, first):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    wanted = Counter((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(odd, prints, first))
    assert rows(got, "doc_id", "fingerprint", "component_id") == wanted
    docs = documents(spark, odd, CLASH)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(first))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tree_size", [8_192, 40])
def test_shard_links_lose_no_component(spark, tree_size, monkeypatch):
    monkeypatch.setattr(simhash, "FOREST_ROWS", 100)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 150, dtype=np.uint64)[rng.integers(0, 150, 900)]
    for _ in range(3):
        prints ^= (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * rng.integers(0, 2, 900).astype(np.uint64)
    prints[:300] = prints[0] ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64))  # a large shard
    prints = np.unique(prints)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f bigint")
    found = connected_components(simhash.shard_links(table, 4, tree_size)).collect()
    part = {r["node"]: r["component"] for r in found}
    got = [part.get(int(x), int(x)) for x in prints.view(np.int64)]
    wanted = plain.groups([int(x) for x in prints])
    assert len(set(zip(got, wanted))) == len(set(got)) == len(set(wanted))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201)]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    wanted = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert {r["node"]: r["component"] for r in found} == wanted and len(found) == len(wanted)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for letters in (2, 3, 26):
        for _ in range(60):
            text = rng.integers(97, 97 + letters, int(rng.integers(0, 200))).astype(np.uint8).tobytes() * 2
            assert repeats.suffix_array(text, 999).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("most_runs", [2_000, 1])
def test_repeats(spark, odd, most_runs, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 1_000)
    got = repeats.remove_repeats(documents(spark, odd, CLASH), most_runs=most_runs).collect()
    wanted = plain.repeats([t for _, t in odd])
    assert Counter(
        (r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in got
    ) == Counter((i, n, tuple(s), k) for (i, _), (n, s, k) in zip(odd, wanted))
    assert any(s for _, s, _ in wanted) and not all(s for _, s, _ in wanted)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_as_text(spark):
    text = "é" * 300 + "".join(chr(200 + i) for i in range(90))
    cut = repeats.remove_repeats(documents(spark, [(1, text), (2, "a" + text)]), as_text=True, carry=["lang"])
    assert all(r["lang"] == "en" and "�" not in r["kept"] for r in cut.collect())


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert quality.judge_quality(none).count() == 0 and quality.keep_good(none).count() == 0
    assert tokens.token_digest(none, TOKENIZER).count() == 0


def test_digests_are_lower_hex():
    assert plain.contamination([(1, None)], [])[0][4] == hashlib.sha256(b"").hexdigest()
