"""Personal-data findings, counts, redaction and governed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import pin
from govlattice.functions.text import (
    digits_only,
    fold,
    pattern,
    spans,
    valid_check_digits,
)
from govlattice.rules import personal_data as R

CANDIDATE_TYPE = (
    "struct<rank:double,length:int,start:int,matcher:int,end:int,"
    "entity_type:string,text_span:string,category:string,confidence:double>"
)
FINDING_TYPE = (
    "struct<entity_type:string,text_span:string,start:int,end:int,"
    "category:string,confidence:double>"
)
_C = R.CONFIDENCE


def _candidate(span: Column, matcher: int, entity: str, confidence: Column | float) -> Column:
    """Candidate whose natural order is the order of acceptance.

    Higher confidence first, then the longer span, then the earlier one.
    """
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        (-conf).alias("rank"),
        (span["start"] - span["end"]).alias("length"),
        span["start"].alias("start"),
        F.lit(matcher).alias("matcher"),
        span["end"].alias("end"),
        F.lit(entity).alias("entity_type"),
        span["text"].alias("text_span"),
        F.lit("personal").alias("category"),
        conf.alias("confidence"),
    ).cast(CANDIDATE_TYPE)


def _slice_before(text: Column, start: Column, chars: int) -> Column:
    first = F.greatest(start - chars, F.lit(0))
    return F.substring(text, first + 1, start - first)


def _numbered(text: Column, formatted: str, plain: str, weights, entity: str, at: int) -> Column:
    """CPF / CNPJ: formatted always counts, bare digits only when valid."""

    def shaped(s: Column) -> Column:
        ok = valid_check_digits(digits_only(s["text"]), weights)
        conf = F.when(ok, _C["formatted_valid"]).otherwise(_C["formatted_invalid"])
        return _candidate(s, at, entity, conf)

    bare = F.filter(
        spans(text, pattern(plain)), lambda s: valid_check_digits(s["text"], weights)
    )
    return F.concat(
        F.transform(spans(text, pattern(formatted)), shaped),
        F.transform(bare, lambda s: _candidate(s, at + 1, entity, _C["plain_valid"])),
    )


def _postal_codes(text: Column) -> Column:
    near = pattern(R.CEP_CONTEXT, ignore_case=True)
    bare = F.filter(
        spans(text, pattern(R.CEP_PLAIN)),
        lambda s: _slice_before(text, s["start"], R.CEP_CONTEXT_CHARS).rlike(near),
    )
    return F.concat(
        F.transform(
            spans(text, pattern(R.CEP_FORMATTED)),
            lambda s: _candidate(s, 5, "CEP", _C["cep_formatted"]),
        ),
        F.transform(bare, lambda s: _candidate(s, 6, "CEP", _C["cep_plain"])),
    )


def _phones(text: Column) -> Column:
    def confidence(s: Column) -> Column:
        digits = digits_only(s["text"])
        plausible = (
            F.length(digits).isin(10, 11)
            & (F.substring(digits, 1, 2).try_cast("int") >= 11)
            & ((F.length(digits) == 10) | (F.substring(digits, 3, 1) == "9"))
        )
        return F.when(s["text"].rlike(R.PHONE_PUNCTUATION), _C["phone_punctuated"]).when(
            plausible, _C["phone_bare"]
        )

    with_area = F.transform(
        spans(text, pattern(R.PHONE_WITH_AREA)),
        lambda s: _candidate(s, 7, "TELEFONE", confidence(s)),
    )
    return F.concat(
        F.filter(with_area, lambda c: c["confidence"].isNotNull()),
        F.transform(
            spans(text, pattern(R.PHONE_WITHOUT_AREA)),
            lambda s: _candidate(s, 8, "TELEFONE", _C["phone_local"]),
        ),
    )


def _after_keyword(
    text: Column, keyword: str, value: str, chars: int, at: int, entity: str, conf: float
) -> Column:
    """A value found in the characters that follow a keyword."""

    def hit(s: Column) -> Column:
        window = F.substring(text, s["end"] + 1, F.lit(chars))
        found = F.regexp_extract(window, value, 0)
        start = s["end"] + F.regexp_instr(window, F.lit(value)) - 1
        return F.when(
            window.rlike(value),
            _candidate(
                F.struct(
                    start.alias("start"),
                    (start + F.length(found)).alias("end"),
                    found.alias("text"),
                ),
                at,
                entity,
                conf,
            ),
        )

    keywords = spans(text, pattern(keyword, ignore_case=True))
    return F.array_compact(F.transform(keywords, hit))


def _names(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted({_py_fold(w) for w in R.NAME_STOPWORDS})])

    def keep(s: Column) -> Column:
        parts = F.split(s["text"], r"(?U)\s+")
        stopped = F.exists(
            parts,
            lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
            & F.array_contains(stop, fold(w)),
        )
        before = _slice_before(text, s["start"], 2)
        sentence_start = (s["start"] == 0) | before.rlike(pattern(R.SENTENCE_END_BEFORE))
        return ~stopped & ~sentence_start

    kept = F.filter(spans(text, pattern(R.NAME)), keep)
    return F.transform(kept, lambda s: _candidate(s, 11, "NOME", _C["name"]))


def _py_fold(word: str) -> str:
    return word.lower().translate(str.maketrans(R.FOLD_FROM, R.FOLD_TO))


def _escape(word: str) -> str:
    return _py_fold(word).replace("-", r"\-")


def _accent_classes(word: str) -> str:
    """Pattern of a folded word that also accepts its accented spellings."""
    out = []
    for letter in word:
        accented = [a for a, base in zip(R.FOLD_FROM, R.FOLD_TO) if base == letter]
        out.append(f"[{letter}{''.join(accented)}]" if accented else letter)
    return "".join(out)


def _any_keyword(keywords) -> str:
    """One pattern for a keyword list, branching on the first two letters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for word in sorted({_py_fold(k) for k in keywords}):
        tree.setdefault(word[0], {}).setdefault(word[1], []).append(word[2:])
    branches = []
    for first, seconds in tree.items():
        inner = [
            f"{_accent_classes(second)}(?:{'|'.join(_accent_classes(t) for t in tails)})"
            for second, tails in seconds.items()
        ]
        branches.append(f"{_accent_classes(first)}(?:{'|'.join(inner)})")
    return pattern(rf"(?=[{''.join(tree)}{R.FOLD_FROM}])\b(?:{'|'.join(branches)})\b")


def _sensitive(text: Column, lowered: Column) -> Column:
    """Every keyword occurrence; keywords do not compete with each other.

    One combined test on the lower-cased text decides whether the keywords are
    looked up at all: most texts hold none of them.
    """
    words = [(e, k) for e, ks in R.SENSITIVE_KEYWORDS.items() for k in ks]
    table = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(100 + i).alias("at"),
                F.lit(pattern(rf"\b{_escape(keyword)}\b")).alias("regex"),
            )
            for i, (entity, keyword) in enumerate(words)
        ]
    )
    folded = fold(text)

    def mentions(k: Column) -> Column:
        return F.transform(spans(folded, k["regex"]), lambda s: _mention(text, k, s))

    empty = F.array().cast(f"array<{CANDIDATE_TYPE}>")
    return F.when(
        lowered.rlike(_any_keyword(k for _, k in words)),
        F.flatten(F.transform(table, mentions)),
    ).otherwise(empty)


def _mention(text: Column, k: Column, s: Column) -> Column:
    return F.struct(
        F.lit(-_C["sensitive"]).alias("rank"),
        (s["start"] - s["end"]).alias("length"),
        s["start"].alias("start"),
        k["at"].alias("matcher"),
        s["end"].alias("end"),
        k["entity"].alias("entity_type"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text_span"),
        F.lit("sensitive").alias("category"),
        F.lit(_C["sensitive"]).alias("confidence"),
    ).cast(CANDIDATE_TYPE)


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy choice of non-overlapping spans, best candidate first."""
    empty = F.array().cast(f"array<{CANDIDATE_TYPE}>")

    def accept(taken: Column, cand: Column) -> Column:
        clash = F.exists(
            taken, lambda t: (cand["end"] > t["start"]) & (cand["start"] < t["end"])
        )
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(cand)))

    return F.when(F.size(candidates) <= 1, candidates).otherwise(
        F.aggregate(F.sort_array(candidates), empty, accept)
    )


def _personal_candidates(text: Column, lowered: Column) -> Column:
    """All candidates, each family behind the cheapest test that can rule it out."""
    empty = F.array().cast(f"array<{CANDIDATE_TYPE}>")

    def gated(test: Column, found: Column) -> Column:
        return F.when(test, found).otherwise(empty)

    numbers = F.concat(
        _numbered(text, R.CPF_FORMATTED, R.CPF_PLAIN, R.CPF_WEIGHTS, "CPF", 0),
        _numbered(text, R.CNPJ_FORMATTED, R.CNPJ_PLAIN, R.CNPJ_WEIGHTS, "CNPJ", 2),
        _postal_codes(text),
        _phones(text),
        gated(
            lowered.contains("rg"),
            _after_keyword(
                text,
                R.RG_KEYWORD,
                pattern("^" + R.RG_NUMBER),
                R.RG_WINDOW_CHARS,
                9,
                "RG",
                _C["rg"],
            ),
        ),
    )
    emails = F.transform(
        spans(text, pattern(R.EMAIL)), lambda s: _candidate(s, 4, "EMAIL", _C["email"])
    )
    births = _after_keyword(
        text,
        R.BIRTH_KEYWORD,
        pattern(R.BIRTH_DATE, ignore_case=True),
        R.BIRTH_WINDOW_CHARS,
        10,
        "DATA_NASCIMENTO",
        _C["birth_date"],
    )
    return F.concat(
        # Every number family holds three digits in a row.
        gated(text.rlike(r"(?U)\d{3}"), numbers),
        gated(text.contains("@"), emails),
        gated(lowered.contains("nasc") | lowered.contains("dn"), births),
        _names(text),
    )


def detect_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii`` (all findings by position) and ``has_sensitive``.

    Runs row by row inside the JVM: no shuffle, no Python worker. The costly
    arrays are pinned because later steps read them repeatedly.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("_lower", F.lower(safe))
    staged = pin(staged, "_candidates", _personal_candidates(safe, F.col("_lower")))
    staged = pin(staged, "_mentions", _sensitive(safe, F.col("_lower")))
    staged = staged.withColumn("_resolved", resolve_overlaps(F.col("_candidates")))

    # Sorted by start; at equal starts personal spans come before mentions and
    # mentions keep the order of their keyword list.
    def by_position(c: Column) -> Column:
        fields = "start matcher end entity_type text_span category confidence".split()
        return F.struct(*[c[f].alias(f) for f in fields])

    def finding(c: Column) -> Column:
        fields = "entity_type text_span start end category confidence".split()
        return F.struct(*[c[f].alias(f) for f in fields])

    ordered = F.sort_array(F.transform(F.concat("_resolved", "_mentions"), by_position))
    return (
        pin(staged, "pii", F.transform(ordered, finding))
        .withColumn("has_sensitive", F.size("_mentions") > 0)
        .drop("_lower", "_candidates", "_mentions", "_resolved")
    )


def explode_findings(detected: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding.

    The outer generator keeps Spark from testing the array for emptiness below
    the detection, which would evaluate the whole detection twice.
    """
    return detected.select(*keys, F.inline_outer("pii")).filter("start IS NOT NULL")


def type_counts(pii: Column, types: tuple[str, ...] = R.ALL_TYPES) -> dict[str, Column]:
    return {
        t: F.size(F.filter(pii, lambda f, t=t: f["entity_type"] == t)).cast("bigint")
        for t in types
    }


def summarize_findings(detected: DataFrame, keys: list[str]) -> DataFrame:
    """Per text: number of findings, counts by type, sensitive flag."""
    counts = type_counts(F.col("pii"))
    entries = F.array(
        *[F.struct(F.lit(t).alias("k"), c.alias("v")) for t, c in counts.items()]
    )
    present = F.filter(entries, lambda e: e["v"] > 0)
    return detected.select(
        *keys,
        F.size("pii").cast("bigint").alias("n_findings"),
        "has_sensitive",
        F.map_from_entries(present).alias("counts"),
    )


def quick_flags(text: Column) -> dict[str, Column]:
    """Cheap pattern counts without spans, validation or competition.

    For screening: which texts are worth the full detection at all.
    """
    plain = F.coalesce(text, F.lit(""))
    counted = {
        "cpf_formatted": R.CPF_FORMATTED,
        "cnpj_formatted": R.CNPJ_FORMATTED,
        "email": R.EMAIL,
        "cep_formatted": R.CEP_FORMATTED,
        "phone": R.PHONE_WITH_AREA,
    }
    out = {
        name: F.regexp_count(plain, F.lit(pattern(p))).cast("bigint")
        for name, p in counted.items()
    }
    lowered = F.lower(plain)
    for entity, keywords in R.SENSITIVE_KEYWORDS.items():
        out[entity.lower()] = lowered.rlike(_any_keyword(keywords))
    return out


def redact(text: Column, pii: Column) -> Column:
    """Replace every span by ``[REDACTED:TYPE]``.

    Overlapping spans are merged first and carry the type of the most certain
    (then longest, then earliest) one, so a placeholder is never cut in two.
    """
    piece = "struct<start:int,end:int,conf:double,size:int,label:string>"
    empty = F.array().cast(f"array<{piece}>")

    def merge(done: Column, f: Column) -> Column:
        size = f["end"] - f["start"]
        fresh = F.struct(
            f["start"].alias("start"),
            f["end"].alias("end"),
            f["confidence"].alias("conf"),
            size.alias("size"),
            f["entity_type"].alias("label"),
        ).cast(piece)
        last = F.element_at(done, -1)
        stronger = (f["confidence"] > last["conf"]) | (
            (f["confidence"] == last["conf"]) & (size > last["size"])
        )
        merged = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], f["end"]).alias("end"),
            F.when(stronger, f["confidence"]).otherwise(last["conf"]).alias("conf"),
            F.when(stronger, size).otherwise(last["size"]).alias("size"),
            F.when(stronger, f["entity_type"]).otherwise(last["label"]).alias("label"),
        ).cast(piece)
        overlaps = (F.size(done) > 0) & (f["start"] < F.try_element_at(done, F.lit(-1))["end"])
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(overlaps, F.concat(head, F.array(merged))).otherwise(
            F.concat(done, F.array(fresh))
        )

    merged = F.aggregate(pii, empty, merge)

    def write(acc: Column, m: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, m["start"] - acc["pos"])
        return F.struct(
            m["end"].alias("pos"),
            F.concat(acc["out"], kept, F.lit("[REDACTED:"), m["label"], F.lit("]")).alias("out"),
        )

    init = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    rebuilt = F.aggregate(
        merged,
        init,
        write,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(pii) == 0, text).otherwise(rebuilt)


def govern_memory(
    items: DataFrame, content: str = "content", ttl_days: str | None = None,
    created_at: str = "created_at",
) -> DataFrame:
    """Redact, classify and date memory items before they are stored.

    ``ttl_days`` of zero or NULL means the item never expires.
    """
    detected = detect_personal_data(items, content)
    category = (
        F.when(F.col("has_sensitive"), "sensitive")
        .when(F.size("pii") > 0, "personal")
        .otherwise("not_personal")
    )
    out = detected.withColumns(
        {
            "category": category,
            "redacted": F.size("pii") > 0,
            "_stored": redact(F.col(content), F.col("pii")),
        }
    )
    expires = F.lit(None).cast("timestamp")
    if ttl_days:
        expires = F.when(
            F.col(ttl_days) > 0,
            F.col(created_at).cast("timestamp") + F.make_dt_interval(F.col(ttl_days)),
        )
    return (
        out.withColumn("expires_at", expires)
        .withColumn(content, F.col("_stored"))
        .drop("_stored", "pii", "has_sensitive")
    )


def active_items(items: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    return items.filter(F.col(expires_at).isNull() | (F.col(expires_at) > now))


def purge_expired(
    items: DataFrame, now: Column, expires_at: str = "expires_at"
) -> tuple[DataFrame, DataFrame]:
    """The items that stay and a one-row count of those that go."""
    active = F.col(expires_at).isNull() | (F.col(expires_at) > now)
    gone = items.agg(F.count_if(~active).alias("purged"))
    return items.filter(active), gone
