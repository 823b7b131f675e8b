"""URL rules, main text, chat pairs and language-model scores."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from govlattice.llm import chat, language_model, main_text, url_rules
from govlattice.llm.queries import URL_RULES

from . import plain
from .conftest import BASE, documents

RULES = [(r.verdict, r.name[: r.name.index("/")], r.name[r.name.index("/") :]) for r in URL_RULES]
URLS = [
    None, "", "no scheme.com/", "http://", "http://com", "https://com/", "https://COM/x", "https://a.Com/x?q#f",
    "https://example.com/en", "https://example.com/en/", "http://m.example.com/en/x", "https://www.example.com/en/1",
    "https://a.www.EXAMPLE.com/en/1", "https://xexample.com/en/1", "https://x.net/es/1", "https://net/fr/", "x://net",
    "https://x.net/a.com/", "https://x.org/.com/", "a://b://c.com/d", "https://x.com?en/", "https://x.com#/en/",
    "https://ü.com/é/日本", "https://x.com/" + "a" * 5000, "https://x\n.com/\n", "https://İ.example.com/en/",
]


def test_urls(spark):
    rows = [(i, u, "clash") for i, u in enumerate([*URLS, *URLS[:8], None])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = url_rules.judge_urls(pages, URL_RULES).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter(
        (i, *plain.url_verdict(u, RULES)) for i, u, _ in rows
    )
    assert url_rules.judge_urls(pages.limit(0), URL_RULES).count() == 0
    none = url_rules.judge_urls(pages, [], default="block")
    assert none.filter("verdict <> 'block' or rule is not null").count() == 0


def test_automaton_is_like_regular_expressions():
    rng = np.random.default_rng(4)
    patterns = ["".join(rng.choice(list("ab/*."), int(rng.integers(1, 9)))) for _ in range(60)] + ["", "**", "*", "\\*a"]
    texts = ["".join(rng.choice(list("ab/.*é"), int(rng.integers(0, 9)))) for _ in range(300)]
    got = url_rules.GlobAutomaton(patterns).match(texts)
    for k, pattern in enumerate(patterns):
        parts = url_rules._elements(pattern)
        regex = "".join({"*": "[^/]*", "**": "(?s:.*)"}.get(e) or re.escape(e[1]) for e in parts)
        assert got[:, k].tolist() == [bool(re.fullmatch(regex, t)) for t in texts], pattern


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><body class=x><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h2>Head&shy;line &amp; more</h2></header><p>One <b>bold</b> and<br>two<p>Unclosed &lt;tag&gt;
&#228;&#x20AC;&nbsp; x</p><!-- no <p>comment</p> --><script>var a = "<p>no</p>"</script><div>In a <i>div</i></div>
<aside>Side</aside><div class="ad">Buy</div><form><p>Mail <input name=a></p></form><ul><li>first<li>second</ul>
<footer>By me</footer><section class="comments"><p>First!</p></section></article>
<div id=sidebar><p>More</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Head­line & more\nOne bold and two\nUnclosed <tag> ä€ x\nIn a div\nfirst\nsecond"


def test_main_text(spark):
    pages = [(0, "https://a.org/1", PAGE), (0, "https://a.org/1", PAGE), (1, None, None), (None, "x", ""), (3, "u", "plain text"),
             (4, "https://b.org/1", "<article>" + "<p>a long text</p>" * 5000 + "</article>"),
             (5, "https://c.org/", "<nav>Only <p>menu"), (6, "https://c.org/2", "</p></article><p>loose")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.extract_main_text(table).collect())
    texts = [TEXT, TEXT, "", "", "plain text", "\n".join(["a long text"] * 5000), "", "loose"]
    assert got == Counter((i, u, t, len(t)) for (i, u, _), t in zip(pages, texts))
    assert main_text.extract_main_text(table.limit(0)).count() == 0


def test_style_trees_tell_template_from_content(spark):
    """No tag or class says what is what: only what varies between the pages of the host stays."""
    pages = []
    for i in range(30):
        body = "".join(f"<p>text {i} {k}</p>" for k in range(1 + i % 7))
        pages.append((i, "https://t.org/p", f"<div><p>Welcome</p><p>to us</p></div><div class=b>{body}</div><div class=z><p>The end</p></div>"))
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text.extract_main_text(table).collect()}
    assert got == {i: "\n".join(f"text {i} {k}" for k in range(1 + i % 7)) for i in range(30)}


def test_main_text_of_the_pages(spark):
    table = spark.read.parquet(f"{BASE}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text.extract_main_text(table).collect()}
    assert got == {r["page_id"]: plain.article(r["html"]) for r in table.collect()}


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    both = [turn("system", "S"), turn("user", "U")]
    data = [
        (1, [*both, turn("assistant", "A")], [*both, turn("assistant", "B")]),
        (2, both, both),
        (3, None, [turn("user", "x")]),
        (4, [*both, turn("assistant", "A"), turn("user", "m")], both),
        (4, [turn("assistant", "")], [turn("user", "")]),
    ]
    kind = "array<struct<role: string, text: string>>"
    pairs = spark.createDataFrame(data, f"_conv bigint, _chosen {kind}, _rejected {kind}")
    out = chat.format_preferences(pairs)
    rows = [tuple(r) for r in out.select(
        "conv_id", "n_common", "prompt", "chosen", "rejected", chat.mask_text(out["chosen_mask"]), chat.mask_text(out["rejected_mask"])
    ).collect()]
    said = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    prompt = said("system", "S") + said("user", "U")
    assert Counter(rows) == Counter([
        (1, 2, prompt, said("assistant", "A"), said("assistant", "B"), "34+", "34+"),
        (2, 2, prompt, "", "", "", ""),
        (3, 0, "", "", said("user", "x"), "", "29-"),
        (4, 2, prompt, said("assistant", "A") + said("user", "m"), "", "34+,29-", ""),
        (4, 0, "", said("assistant", ""), said("user", ""), "33+", "28-"),
    ])
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_conversations_with_odd_rows(spark):
    rows = [(0, 2, "assistant", "b"), (0, 0, "user", "a"), (0, None, None, None), (0, 0, "user", "a"), (None, 0, "user", "n"),
            (1, 5, "user", "only"), (2, 0, "user", "q"), (2, 9, "assistant", "r")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("_n", chat.F.lit(1))
    conversations = chat.conversations_of(turns)
    got = {r["_conv"]: [tuple(t) for t in r["_turns"]] for r in conversations.collect()}
    assert got == {0: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "n")],
                   1: [("user", "only")], 2: [("user", "q"), ("assistant", "r")]}
    pairs = chat.swapped_replies(conversations, chat.F.col("_conv").bitwiseXOR(chat.F.lit(2)))
    sides = {r["_conv"]: (r["_chosen"], r["_rejected"]) for r in pairs.collect()}
    assert [t["text"] for t in sides[0][1]] == ["", "a", "a", "r"] and [t["text"] for t in sides[2][1]] == ["q", "b"]
    assert sides[1][0] == sides[1][1] and sides[None][0] == sides[None][1]
    assert chat.format_preferences(chat.swapped_replies(conversations.limit(0), chat.F.col("_conv"))).count() == 0


SMALL = language_model.Settings(words=30, buckets=16, known_words=60, width=8, steps=150)
# No word has a vector.
PLAIN_BUCKETS = language_model.Settings(words=30, buckets=16, known_words=60, width=8, steps=150, least=10**9)


def test_scores(spark, odd):
    got = language_model.score_texts(documents(spark, odd, ("word", "c", "_row")), settings=SMALL).collect()
    wanted = plain.unigrams(odd, odd)
    texts = {}
    for (i, t), (n, known, total, base) in wanted.items():
        texts.setdefault(i, []).append((n, known, total, round(base, 6)))
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) in texts[r["doc_id"]]
        assert r["score"] < 0
    assert len(got) == len(odd)
    assert language_model.score_texts(documents(spark, []), settings=SMALL).count() == 0


def test_words_of_a_bucket_share_its_probability(spark):
    """Scores of one-word texts: over all words and one unseen one per bucket, those of a class sum up to it."""
    words = [f"w{i}" for i in range(90)]
    rng = np.random.default_rng(1)
    texts = [(7 * i, " ".join(rng.choice(words, 30))) for i in range(60)]
    seen = sorted({w for i, t in texts if plain.zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    unseen = {language_model.bucket_of(w.encode(), SMALL): w for w in (f"z{k}" for k in range(5_000))}
    out = [i for i in range(100_000, 110_000) if plain.zlib.crc32(str(i).encode()) % 7 == 2]
    probes = dict(zip(out, [*seen, *unseen.values(), ""]))
    got = language_model.score_texts(documents(spark, [*texts, *probes.items()]), settings=PLAIN_BUCKETS).collect()
    score = {probes[r["doc_id"]]: r["score"] for r in got if r["doc_id"] in probes}
    # p(word) p(end | class) summed over words is p(not empty) times a mean of p(end | class), so below it.
    assert 0 < sum(10**x for w, x in score.items() if w) < 1 - 10 ** score[""]
    count = Counter(w for i, t in texts if plain.zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    by_bucket = {}
    own = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: SMALL.words]}
    for w in [*seen, *unseen.values()]:
        if w not in own:
            by_bucket.setdefault(language_model.bucket_of(w.encode(), SMALL), []).append((count[w] + 1, score[w]))
    # Within a bucket the probability follows the smoothed count.
    for shares in by_bucket.values():
        assert np.allclose([x - np.log10(c) for c, x in shares], shares[0][1] - np.log10(shares[0][0]))


def plain_scores(train: list, texts: list, settings) -> dict:
    """Scores with every sum over words written out, one word and context at a time."""
    lm, first = language_model, settings.words + 1
    split = lambda t: [w.lower().encode() for w in t.split()]
    count = Counter(w for t in train for w in split(t))
    ranked = sorted(count, key=lambda w: (-count[w], w))
    of = {w: i if i < settings.words else lm.bucket_of(w, settings) for i, w in enumerate(ranked)}
    class_of = lambda w: of.get(w, lm.bucket_of(w, settings))
    pairs, by_word = np.zeros((settings.classes, settings.classes)), {}
    for t in train:
        before = settings.words
        for w in split(t):
            pairs[before, class_of(w)] += 1
            by_word.setdefault(w, np.zeros(settings.classes))[before] += 1
            before = class_of(w)
        pairs[before, settings.words] += 1
    logs, r = lm.train(pairs, settings)
    contexts = lm.inner_contexts(r, pairs, settings)
    fit = {}
    for w in ranked[settings.words :]:
        after = pairs[:, class_of(w)]
        if count[w] >= settings.least:
            share = np.array([count[w] / (after.sum() + 1)], np.float32)
            q = lm.word_vectors(by_word[w][None].astype(np.float32), after[None].astype(np.float32), share, contexts, settings)
            fit[w] = (q @ contexts.T)[0].astype(float)
    inner = ranked[settings.words :]
    out = {}
    for t in texts:
        before, score = settings.words, 0.0
        for w in split(t):
            k = class_of(w)
            score += logs[before, k]
            if k >= first:
                weigh = lambda v: (count[v] + 1) * np.exp(fit[v][before] if v in fit else 0.0)  # noqa: E731, B023
                everything = 1 + sum(weigh(v) for v in inner if class_of(v) == k)
                score += np.log((weigh(w) if w in count else 1) / everything)
            before = k
        out[t] = (score + logs[before, settings.words]) / np.log(10)
    return out


@pytest.mark.parametrize("known_words", [500, 60, 35])
def test_scores_equal_plain_sums(spark, known_words):
    """All words held by tasks, some and hardly any: the vectors of words decide, and sums are the plain ones."""
    rng = np.random.default_rng(4)
    words = [f"{'ab'[i % 2]}{i}" for i in range(120)]
    texts = []
    for i in range(300):
        # Words of one parity follow each other, so contexts tell words of a bucket apart.
        mine = words[i % 2 :: 2]
        texts.append((i, " ".join(rng.choice(mine, rng.integers(0, 40), p=np.arange(60, 0, -1) / 1830))))
    texts += [(1_000, "a0 never b1 seen"), (1_001, "")]
    learn = [t for i, t in texts if plain.zlib.crc32(str(i).encode()) % 7 != 2]
    settings = language_model.Settings(words=30, buckets=5, known_words=known_words, width=8, steps=60, least=6, inner_width=4)
    got = language_model.score_texts(documents(spark, texts), settings=settings).collect()
    wanted = plain_scores(learn, [t for _, t in texts], settings)
    for r in got:
        assert r["score"] == pytest.approx(wanted[dict(texts)[r["doc_id"]]], rel=1e-4, abs=1e-3)
    flat = language_model.Settings(words=30, buckets=5, known_words=known_words, width=8, steps=60, least=10**9)
    without = language_model.score_texts(documents(spark, texts), settings=flat).collect()
    held = lambda rows: sum(r["score"] for r in rows if r["held_out"])
    assert held(got) > held(without) + 10


def test_training_normalises_and_learns():
    rng = np.random.default_rng(0)
    size = SMALL.classes
    pairs = np.zeros((size, size))
    for h in range(size):
        pairs[h, (h * 7 + np.arange(3)) % size] = rng.integers(50, 100, 3)
    logs, _ = language_model.train(pairs, SMALL)
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    plain_log = np.log(pairs.sum(axis=0) / pairs.sum())
    assert (pairs * logs).sum() > (pairs * plain_log[None, :]).sum() + 0.5 * pairs.sum()


@pytest.mark.parametrize("held", [True, False])
def test_scores_beat_word_frequencies(spark, held):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    settings = language_model.Settings(words=300, buckets=64, width=24, steps=120)
    scored = language_model.score_texts(docs, settings=settings).filter(f"held_out = {held}")
    row = scored.selectExpr("sum(score) - sum(base_score)", "sum(n_tokens)").first()
    assert row[0] > 0.1 * row[1]


@pytest.mark.parametrize("held_nodes", [20_000, 0])
def test_trees_judge_pages_with_articles(spark, held_nodes):
    """A box that all articles of a host share goes, what varies beside an article stays, copies count once."""
    pages = []
    for i in range(30):
        body = "".join(f"<p>text {i} {k}</p>" for k in range(1 + i % 7))
        pages.append((i, "https://t.org/p", f"<article><div class=box><p>Read on</p></div>{body}</article>"
                      f"<div class=b><p>more {i}</p>{'<p>and more</p>' * (i % 7)}</div><div class=z><p>The end</p></div>"))  # fmt: skip
    pages += [(100 + i, "https://copies.org/", "<article><p>one page</p></article><footer>" + "x" * i + "</footer>") for i in range(30)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text.extract_main_text(table, held_nodes=held_nodes).collect()}
    wanted = {i: "\n".join([f"text {i} {k}" for k in range(1 + i % 7)] + [f"more {i}"] + ["and more"] * (i % 7)) for i in range(30)}
    assert got == wanted | {100 + i: "one page" for i in range(30)}


ARTICLE = "<article><p>The text</p></article>"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f'<body class="has-sidebar">{ARTICLE}</body>', "The text"),
        (f'<body class="sidebar"><div class="layout with-sidebar">{ARTICLE}</div><div class=sidebar><p>Side</div></body>', "The text"),
        (f'<div id="content-no-comments">{ARTICLE}</div>', "The text"),
        (f'<form id=aspnetForm><nav>Menu</nav>{ARTICLE}<div class="site-footer">Foot</div></form>', "The text"),
        ("<form id=aspnetForm><nav>Menu</nav><div><p>A page without an article</div></form>", "A page without an article"),
        (f'<div class="widget"><nav>Menu</nav>{ARTICLE}</div>', "The text"),
        ('<article><div class="social-policy"><p>On social policy</div><div class="social-share">Tell</div></article>', "On social policy"),
        (f'{ARTICLE}<div id=comments><article><p>First, and much longer than the text</p></article></div>', "The text"),
        (f"<aside>{ARTICLE}</aside>", ""),
        ('<div id=comments><article class="comment"><p>First</p></article></div>', ""),
    ],
)
def test_wrappers_and_parts_of_class_names_remove_nothing(page, wanted):
    regions, blocks = main_text.parse_page(page)
    assert "\n".join(line for at, line in blocks if regions[at].prior > main_text.REMOVED) == wanted


@pytest.mark.parametrize(
    ("inner", "wanted"),
    [
        ('<svg class="i"/><p>text of article</p>', "text of article"),
        ('<p>one <svg viewBox="0 0 1 1"><title>Icon</title><text>drawn</text><path d=""/></svg> two</p>', "one two"),
        ('<svg><g><svg/></g><text>drawn</text></svg><p>after</p><svg/><p>end</p>', "after\nend"),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "where x=2 holds"),
        ("<p>open <svg><text>drawn</p><p>next</p>", "open\nnext"),
    ],
)
def test_drawings_swallow_nothing_and_formulas_stay(inner, wanted):
    regions, blocks = main_text.parse_page(f"<article>{inner}</article>")
    assert "\n".join(line for _, line in blocks) == wanted
