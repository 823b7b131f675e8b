"""Plain versions of the operators over small lists, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_tokenizer = None


def lower(text: str) -> str:
    return text.translate(_LOWER)


def ids_of(text: str | None, end: int) -> list[int]:
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    repeated = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(inside) > 50 * n
    more = 10 * symbols > n or chars < 2 * n or chars > 25 * n or 2 * repeated > n
    return n, chars, symbols, repeated, len(inside), failed, not failed and not more


def contamination(docs: list, items: list, window: int = 13) -> list[tuple]:
    out = []
    wanted = {}
    for item, text in items:
        words = ITEM_WORD.findall(lower(text or ""))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            wanted.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wanted}
    for doc, text in docs:
        words = ITEM_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if here := wanted.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(words)
        out.append((doc, len(words), len(hit), len(found), digest, bad))
    return out


def simhash(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], radius: int = 4) -> list[int]:
    """For each row the position of the first row of its group."""
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def repeats(texts: list[str | None], least: int = 400) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if count[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def url_verdict(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple:
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule_host, rule_path in rules:
        if ("." + host).endswith("." + rule_host) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = rule_host + rule_path, verdict
    return host, path, *(best or (None, default))


class _Article(HTMLParser):
    """Text of the article element alone; blocks end at block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.words = 0, [], []

    def end(self):
        if line := " ".join("".join(self.words).split()):
            self.blocks.append(line)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.words.append(" ")
        elif tag in ("p", "h1", "li", "div"):
            self.end()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "div", "article"):
            self.end()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.words.append(data)


def article(text: str | None) -> str:
    parser = _Article()
    parser.feed(text or "")
    parser.close()
    parser.end()
    return "\n".join(parser.blocks)


def unigrams(docs: list, scored: list) -> dict:
    """Base scores of ``scored`` by counts over ``docs`` that are not held out."""
    count: Counter = Counter()
    for i, text in docs:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*WORD.findall(lower(text or "")), " end"])
    total, kinds = sum(count.values()), len(count)
    out = {}
    for i, text in scored:
        words = [*WORD.findall(lower(text or "")), " end"]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words)
        out[i, text] = len(words), sum(count[w] > 0 for w in words), total, base
    return out
