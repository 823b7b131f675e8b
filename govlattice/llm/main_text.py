"""Main text of web pages by site style trees.

The element trees of all pages of a host are merged: elements with the same
path of tags and classes are one node. Branches of a page are judged at its
containers (article, nav, div and the like). A node is important if its
presentation varies between pages, and if its texts do: both are entropies, of
the sequences of child tags and of the texts over the pages of the host. Tags
and classes that say outright what is no text (footer, adverts, comments, ...)
remove a branch. All others are judged by their importance, those of an article
too: being in or beside an article is a weight of it. Branches of low weight
are removed.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.llm.common import fresh_folder
from govlattice.llm.url_rules import host_of
from govlattice.session import cut_lineage

# Element names and class words that HTML and common practice give a meaning. Fixed values.
SILENT = ("script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas",
          "textarea", "select", "button")
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
CONTAINERS = ("article", "aside", "body", "dialog", "div", "footer", "form", "header", "main", "menu", "nav",
              "search", "section", "table", "ul", "ol")
CONTENT = ("article", "main")
BOILERPLATE = ("aside", "dialog", "footer", "form", "menu", "nav", "search")
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice"
    " notices pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe"
    " toolbar widget widgets".split()
)
# Words that only say which: a class of one of the above and these still names it ("site-footer"), "has-sidebar" does not.
WHICH = frozenset("bottom global left main mobile page post primary right secondary site sub the top".split())
CONTENT_CLASSES = ("articlebody", "main", "main-content", "content-main", "main_content")
_CLOSED_BY_BLOCK = ("p",)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Weights of what tags and classes say: removed, beside an article, no article in the page, in an article.
REMOVED, BESIDE, OPEN, KEPT = 0.0, 0.25, 0.5, 1.0


class _Region:
    __slots__ = ("path", "above", "name", "classes", "prior", "children", "size")

    def __init__(self, path: str, above: _Region | None, name: str, classes: list[str]):
        self.path, self.above, self.name, self.classes = path, above, name, classes
        self.prior, self.size = OPEN, 0
        self.children: list[str] = []


def _names_boilerplate(name: str) -> bool:
    """Whether a whole class says so, not only a part of it."""
    words = set(_WORDS.findall(name))
    return bool(words & BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | WHICH


def _prior(region: _Region, above: float, wrappers: set[_Region]) -> float:
    if above == REMOVED:
        return REMOVED
    inside, name = above == KEPT, region.name
    named = {c for c in region.classes if _names_boilerplate(c)} if name != "body" else set()
    if name in BOILERPLATE or named or (name == "header" and not inside):
        # A header, or a class that only names one, is part of an article when it stands in it.
        if inside and name in ("header", "hgroup", "div", "h1", "h2", "section") and named <= {"header"}:
            return KEPT
        if region not in wrappers:
            return REMOVED
    return KEPT if inside or name in CONTENT or not set(CONTENT_CLASSES).isdisjoint(region.classes) else OPEN


def _weigh(regions: list[_Region], blocks: list[tuple[int, str]]) -> None:
    """Set the priors of a page's regions.

    A form, or a container with a class of boilerplate, is a wrapper and is not
    removed if the only articles of the page are in it; a form also if it holds
    half of the page's text. Articles in other boilerplate go with it.
    """
    for at, line in blocks:
        region: _Region | None = regions[at]
        while region:
            region.size += len(line)
            region = region.above

    def judge(wrappers: set[_Region]) -> bool:
        for r in regions[1:]:
            r.prior = _prior(r, r.above.prior, wrappers)
        return any(r.prior == KEPT and r.size for r in regions)

    wrappers = {r for r in regions if r.name == "form" and 2 * r.size >= regions[0].size}
    if not judge(wrappers):
        for region in regions:
            if region.name in CONTENT and region.size and not any(map(_names_boilerplate, region.classes)):
                outer, around = region.above, set()
                while outer and (outer.name not in BOILERPLATE or outer.name == "form") and outer.name != "header":
                    around.add(outer)
                    outer = outer.above
                if outer is None:
                    wrappers |= around
        judge(wrappers)


def parse_page(text: str) -> tuple[list[_Region], list[tuple[int, str]]]:
    """Regions of a page and its text blocks (number of the region, text) in page order.

    Unclosed elements end with their parent, a paragraph also at the next block.
    Text before any container belongs to the page itself.
    """
    root = _Region("", None, "", [])
    regions, blocks, words = [root], [], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, region, silent
    at = 0

    def end_block() -> None:
        if words:
            if line := " ".join(html.unescape("".join(words)).split()):
                blocks.append((stack[-1][1], line))
            words.clear()

    def close(names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                del stack[depth:]
                return
            if stack[depth][0] in limits:
                return

    for tag in _TAG.finditer(text):
        if tag.start() > at and not stack[-1][2]:
            words.append(text[at : tag.start()])
        at = tag.end()
        if not (name := tag["name"]):
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
            continue
        if name not in BLOCKS and name not in SILENT:
            continue  # inline elements only mark text up
        if name != "svg":  # a drawing in a line does not end it
            end_block()
        if tag["close"]:
            close((name,), ())
            continue
        if name == "body":
            close(("head",), ())
        if name in BLOCKS:
            close(_CLOSED_BY_BLOCK, CONTAINERS)
        if name in _SIBLINGS:
            close(_SIBLINGS[name], ("ul", "ol", "dl", "table", "menu", "article", "section", "nav", "div"))
        _, region, silent = stack[-1]
        regions[region].children.append(name)
        attributes = tag["attributes"]
        if name in CONTAINERS:
            marks = " ".join(next(filter(None, m), "") for m in _CLASS.findall(attributes)).lower()
            above = regions[region]
            classes = sorted(set(marks.split()))
            label = f"{name}.{'.'.join(classes)}" if classes else name
            regions.append(_Region(f"{above.path}/{label}", above, name, classes))
            region = len(regions) - 1
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, region, silent or name in SILENT))
    if not stack[-1][2]:
        words.append(text[at:])
    end_block()
    _weigh(regions, blocks)
    return regions, blocks


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) >> 1


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """Per page: ``_row``, a hash of its texts, and the regions that no tag removes.

    Regions have path, prior, presentation, texts and their hashes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        region_kind = pa.list_(
            pa.struct(
                [("path", pa.string()), ("prior", pa.float64()), ("style", pa.int64()),
                 ("blocks", pa.list_(pa.struct([("at", pa.int64()), ("text", pa.string())]))),
                 ("features", pa.list_(pa.int64()))]
            )
        )
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, numbers, prints = [], [], []
                for text in part.column(3):
                    regions, blocks = parse_page(text.as_py() or "")
                    main = any(r.prior == KEPT for r in regions)
                    held = [
                        {"path": r.path, "prior": BESIDE if main and r.prior == OPEN else r.prior,
                         "style": _hash(" ".join(r.children)), "blocks": [], "features": []}
                        for r in regions
                    ]
                    for at, (region, line) in enumerate(blocks):
                        held[region]["blocks"].append({"at": at, "text": line})
                        held[region]["features"].append(_hash(line))
                    rows.append([r for r in held if r["blocks"] and r["prior"] > REMOVED])
                    prints.append(_hash(repr([(r["path"], r["features"]) for r in rows[-1]])))
                    numbers.append(number)
                    number += 1
                columns = [part.column(0), part.column(1), part.column(2), pa.array(numbers, pa.int64()),
                           pa.array(prints, pa.int64()), pa.array(rows, region_kind)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_url", "_host", "_row", "_print", "_regions"])

    return pages.mapInArrow(
        work,
        f"_id {kind}, _url string, _host string, _row bigint, _print bigint, _regions array<struct<path: string, prior: double,"
        " style: bigint, blocks: array<struct<at: bigint, text: string>>, features: array<bigint>>>",
    )


def node_importance(parsed: DataFrame, decay: float = 0.9) -> DataFrame:
    """``_host``, ``_path`` and ``importance`` between 0 and 1 of every node of every site style tree.

    With l presentations over m pages (l <= m), ``(1 - decay^l) * presentation +
    decay^l * content``: presentation is the entropy of the presentations to the base m,
    content one minus the mean, over texts, of log_m(pages with the text). A
    node of one page has importance 1. Pages of a host with the same texts (but
    for what their tags remove) are one page. All sums are formed per value
    first, so a host of any size is never gathered.
    """
    narrow = F.transform("_regions", lambda r: F.struct(r["path"], r["style"], r["features"]))
    pages = parsed.select("_host", "_print", narrow.alias("_regions")).dropDuplicates(["_host", "_print"])
    nodes = pages.select("_host", F.explode("_regions").alias("_r")).select(
        "_host", F.col("_r.path").alias("_path"), F.col("_r.style").alias("_style"), F.col("_r.features").alias("_f")
    )
    styles = nodes.groupBy("_host", "_path", "_style").agg(F.count(F.lit(1)).alias("c"))
    styles = styles.groupBy("_host", "_path").agg(
        F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("s")
    )
    texts = nodes.select("_host", "_path", F.explode(F.array_distinct("_f")).alias("_text"))
    texts = texts.groupBy("_host", "_path", "_text").agg(F.count(F.lit(1)).alias("c"))
    texts = texts.groupBy("_host", "_path").agg(F.avg(F.log("c")).alias("t"))
    both = styles.join(texts, ["_host", "_path"], "left")
    base = F.log("m")
    presentation = (base - F.col("s") / F.col("m")) / base
    content = 1 - F.coalesce(F.col("t"), F.lit(0.0)) / base
    share = F.pow(F.lit(decay), F.col("l"))
    value = F.when(F.col("m") > 1, (1 - share) * presentation + share * content).otherwise(1.0)
    return both.select("_host", "_path", value.alias("importance"))


def extract_main_text(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least: float = 0.15,
    held_nodes: int = 20_000,
) -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by a line break; empty if none), ``n_chars``.

    A branch that tags or whole class names remove goes with all below it,
    unless it is wrapped around the articles of the page. Any other one,
    in an article or not, stays if the importance of its node times the weight
    of its place is at least ``least``: 1 in an article, 0.5 in a page without
    one, 0.25 beside one. White space inside a block is one space. Null pages
    and urls are empty pages and hosts; repeated rows are extracted each and
    are one page of the trees; an empty table gives no rows; other columns are
    not read. Template nodes are looked up in place up to ``held_nodes`` of
    them, and joined else.
    """
    rows = pages.select(
        F.col(id_column).alias("_id"),
        F.col(url_column).alias("_url"),
        host_of(F.col(url_column)).alias("_host"),
        F.col(html_column).alias("_html"),
    )
    folder = fresh_folder(pages.sparkSession, "regions")
    found = _parsed(rows, rows.schema["_id"].dataType.simpleString())
    found.write.option("compression", "zstd").parquet(folder)
    parsed = pages.sparkSession.read.schema(found.schema).parquet(folder)
    # Nodes that are removed in some place; all others stay wherever they are.
    low = node_importance(parsed).filter(F.col("importance") * BESIDE < least)
    low = cut_lineage(low)

    def stays(prior: Column, importance: Column) -> Column:
        return prior * F.coalesce(importance, F.lit(1.0)) >= least

    if low.limit(held_nodes + 1).count() <= held_nodes:
        # A short list per host: the texts stay where they are.
        entries = F.map_from_entries(F.collect_list(F.struct("_path", "importance"))).alias("_low")
        hosts = F.broadcast(low.groupBy("_host").agg(entries))
        kept = F.filter("_regions", lambda r: stays(r["prior"], F.element_at("_low", r["path"])))
        joined = parsed.join(hosts, "_host", "left").withColumn("_b", F.flatten(F.transform(kept, lambda r: r["blocks"])))
    else:
        regions = parsed.select("_row", "_host", F.explode("_regions").alias("_r")).select(
            "_row", "_host", F.col("_r.path").alias("_path"), F.col("_r.prior").alias("_prior"), F.col("_r.blocks").alias("_blocks")
        )
        kept = regions.join(low, ["_host", "_path"], "left").filter(stays(F.col("_prior"), F.col("importance")))
        blocks = kept.groupBy("_row").agg(F.flatten(F.collect_list("_blocks")).alias("_b"))
        joined = parsed.select("_row", "_id", "_url").join(blocks, "_row", "left")
    lines = F.transform(F.sort_array("_b"), lambda b: b["text"])
    return joined.select(
        F.col("_id").alias(id_column),
        F.col("_url").alias(url_column),
        F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"),
    ).withColumn("n_chars", F.length("text").cast("bigint"))
