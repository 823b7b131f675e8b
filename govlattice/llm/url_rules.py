"""URL rules as one bit-parallel automaton over all glob patterns.

Every pattern gets a row of bits: one for its start and one for each element.
The bits of all patterns stand side by side in 64-bit words, and one Shift-And
step moves all of them over a character of many URLs at once::

    D = ((D << 1) & B[c]) | (D & L[c])

``B`` lets an element be entered by a character, ``L`` lets a wildcard stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of URLs matched in one vectorised step.
STEP_CHARS = 4_000_000


@dataclass(frozen=True)
class UrlRule:
    """A glob over the canonical URL: ``*`` is any run without "/", ``**`` any run, ``\\`` takes the next literally."""

    name: str
    verdict: str
    pattern: str
    weight: int  # the rule with the highest wins, the first of equal ones


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A rule for a host and its subdomains and for paths that start with ``path``."""
    literal = "".join(f"\\{c}" if c in "*\\" else c for c in f".{host}{path}")
    return UrlRule(host + path, verdict, f"*{literal}**", len(host + path))


def _elements(pattern: str) -> list[str]:
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            out.append("=" + pattern[at + 1])
            at += 2
        elif pattern.startswith("**", at):
            out.append("**")
            at += 2
        elif pattern[at] == "*":
            out.append("*")
            at += 1
        else:
            out.append("=" + pattern[at])
            at += 1
    return out


class GlobAutomaton:
    """Shift-And masks of several glob patterns in words of 64 bits."""

    def __init__(self, patterns: Sequence[str]):
        parsed = [_elements(p) for p in patterns]
        letters = sorted({e[1] for p in parsed for e in p if e[0] == "="} | {"/"})
        self.points = np.array([ord(c) for c in letters], np.uint32)
        classes = len(letters) + 1  # the last: any other character
        states = sum(1 + sum(e[0] == "=" for e in p) for p in parsed)
        words = max(1, -(-states // 64))
        enter = np.zeros((classes, words * 64), np.uint8)
        stay = np.zeros((classes, words * 64), np.uint8)
        begin = np.zeros(words * 64, np.uint8)
        slash, ends, at = letters.index("/"), [], 0
        for elements in parsed:
            begin[at] = 1
            for e in elements:
                if e[0] == "=":
                    at += 1
                    enter[letters.index(e[1]), at] = 1
                elif e == "**":
                    stay[:, at] = 1
                else:
                    stay[np.arange(classes) != slash, at] = 1
            ends.append(at)
            at += 1
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
        self.enter, self.stay, self.begin = pack(enter), pack(stay), pack(begin)
        self.ends = np.array(ends, np.int64)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean array: text x pattern."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        codes = np.where(self.points[place] == points, place, len(self.points))
        begins = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        state = np.tile(self.begin, (len(texts), 1))
        live = len(texts)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -at, "left"))  # texts longer than ``at``
            now = state[:live]
            code = codes[begins[:live] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.enter[code]) | (now & self.stay[code])
        out = np.zeros((len(texts), len(self.ends)), bool)
        if len(texts):
            word, bit = self.ends // 64, (self.ends % 64).astype(np.uint64)
            out[order] = (state[:, word] >> bit) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], *, url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    Patterns are matched against "." + host + path. Null urls and urls without
    "://" have an empty host and path and get the default verdict, as do all
    that no rule fits. Columns with these names are replaced, others pass
    through; repeated rows are judged alike; an empty table gives no rows.
    """
    ranked = sorted(rules, key=lambda r: -r.weight)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
        host_of(F.col(f"`{url_column}`")).alias("host"),
        path_of(F.col(f"`{url_column}`")).alias("path"),
    )
    automaton = GlobAutomaton([r.pattern for r in ranked])
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [f".{h}{p}" for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            first = np.full(len(texts), len(ranked))
            ends = np.cumsum([len(t) for t in texts]) // STEP_CHARS
            for group in np.unique(ends):
                at = np.flatnonzero(ends == group)
                hits = automaton.match([texts[i] for i in at])
                first[at] = np.where(hits.any(axis=1), hits.argmax(axis=1), len(ranked)) if len(ranked) else 0
            arrays = [pa.array(names[first], pa.string()), pa.array(verdicts[first], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "rule", "verdict"])

    row = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(work, f"_row {row}, host string, path string, rule string, verdict string")
    return out.select("_row.*", "host", "path", "rule", "verdict")
