"""How far the words of each source of a language stray from those of the others.

Identical texts of a language are one text with a multiplicity per source. It is cut into terms
once, and its term counts enter the counts and document frequencies of its sources with their
multiplicities. Each source gives each kept term a share, smoothed so that absent terms have one
too; as that share is the same for all absent terms of a source, pairs of sources are compared
over terms both have, plus corrections that need only how many terms of a source have which
count. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows
from ebbtide.plans import durable
from ebbtide.plans.ranked import first_per_group

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
PIECE = 1 << 20  # bytes of a text that are cut into terms at one time, about
ENTRIES = 400_000  # counts that a task holds before it hands them on
CHARACTERS = 64 << 20  # of texts counted before that
CELLS = 1 << 20  # pairs that are evaluated at one time
SLICE = 256  # sources of a term that are paired with all others of it in one piece
OTHERS = 1_000  # sources of a language that stand in one row, about
SALTS = 16
LOWER = (1 << 64) - 1
BIG = 9_000_000_000  # counts from which on SCALE x count is no 64-bit number

# Bytes that are no part of a term become blanks, A-Z small letters.
_BLANK = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FORM = bytes(
    0x20 if b in _BLANK else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def terms(text: str) -> Counter:
    """How often a text has each run of letters and of code points beyond ASCII, in UTF-8, A-Z in
    lower case. Of a long text a piece at a time is cut, between terms."""
    raw, found, start = text.encode().translate(_FORM), Counter(), 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[start:end].split())
        start = end
    return found


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, sources (source and number of rows): one row per language and text.

    Only digests meet to count the copies; of each text one copy per task goes through the
    shuffle, so neither a text that a third of the rows hold nor a hot source is a hot key.
    """
    keyed = _named(docs).withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = keyed.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n"))
    sources = copies.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = keyed.groupBy("lang", "key").agg(F.any_value("text").alias("text"))
    return texts.join(sources, ["lang", "key"]).select("lang", "text", "sources")


def _counted(rows):
    """Counts and document frequencies per language, source and term, a bounded number at a time.

    Both are kept in one number, the frequency in its lower 64 bits.
    """
    found: dict[tuple[str, str], dict[bytes, int]] = {}
    held = size = 0

    def rows_out():
        for (lang, source), own in found.items():
            yield (
                [lang] * len(own),
                [source] * len(own),
                [t.decode() for t in own],
                [x >> 64 for x in own.values()],
                [x & LOWER for x in own.values()],
            )

    for langs, texts, sources in rows:
        for lang, text, where in zip(langs, texts, sources):
            times = terms(text)
            size += len(text)
            for x in where:
                own, n = found.setdefault((lang, x["source"]), {}), x["n"]
                held -= len(own)
                for term, k in times.items():
                    own[term] = own.get(term, 0) + (k * n << 64) + n
                held += len(own)
                if held > ENTRIES or size > CHARACTERS:
                    yield from rows_out()
                    found.clear()
                    held = size = 0
    yield from rows_out()


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, entries (source, n) of terms in at least `least` documents of the
    language. An entry per source that has the term."""
    partial = map_rows(
        collapsed(docs),
        ["lang", "text", "sources"],
        _counted,
        "lang string, source string, term string, n bigint, documents bigint",
    )
    # By language and term from the start, so that both groupings need one shuffle; a task has
    # at most a few rows per source and term to send.
    return (
        partial.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
        .groupBy("lang", "term")
        .agg(
            F.sum("n").alias("total"),
            F.sum("documents").alias("documents"),
            F.collect_list(F.struct("source", "n")).alias("entries"),
        )
        .filter(F.col("documents") >= least)
        .drop("documents")
    )


def _share(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE (count + 1) / (n + v)); null for a language without terms."""
    return F.expr(
        f"""1 + CASE WHEN {n} + {v} = 0 THEN NULL
        WHEN {count} < {BIG} THEN ({SCALE} * ({count} + 1)) div ({n} + {v})
        ELSE (cast({SCALE} AS decimal(10, 0)) * cast({count} + 1 AS decimal(20, 0)))
            div cast({n} + {v} AS decimal(20, 0)) END"""
    )


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (its terms counted), v (kept terms of the language), p0 (the share of a
    term it has not) of every group, those without text too."""
    own = (
        kept.select("lang", F.explode("entries").alias("x"))
        .groupBy("lang", F.col("x.source").alias("source"))
        .agg(F.sum("x.n").alias("n"))
    )
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    return (
        _named(docs.select("lang", "source", F.lit("").alias("text")))
        .groupBy("lang", "source")
        .agg(F.lit(0).alias("_"))
        .join(own, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "v")])
        .withColumn("p0", _share("0", "n", "v"))
    )


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sum of each."""
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, values)
    return distinct, sums


def _both_have(rows):
    """What pairs of sources that share a term add to their sums, beyond what either adds alone."""
    for langs, begins, ends, names, shares, absent in rows:
        number: dict[tuple[str, str], int] = {}
        size = np.array([len(x) for x in names], np.int64)
        offset = np.concatenate([[0], np.cumsum(size)])
        who = np.array(
            [number.setdefault((g, x), len(number)) for g, own in zip(langs, names) for x in own], np.int64
        )
        p, p0 = (np.array([x for own in cols for x in own], np.int64) for cols in (shares, absent))
        label = list(number)
        lefts = np.concatenate([np.arange(b, e) + o for b, e, o in zip(begins, ends, offset)] or [[]]).astype(np.int64)
        row = np.searchsorted(offset, lefts, "right") - 1
        upto = np.cumsum(size[row])
        start = 0
        while start < len(lefts):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + CELLS)))
            own, many = lefts[start:end], size[row[start:end]]
            a = np.repeat(own, many)
            b = np.arange(len(a)) + np.repeat(offset[row[start:end]] - (np.cumsum(many) - many), many)
            a, b = a[a != b], b[a != b]
            value = _spread(p[a], p[b]) - _spread(p[a], p0[b]) - _spread(p0[a], p[b]) + _spread(p0[a], p0[b])
            keys, sums = _summed(who[a] * len(label) + who[b], value)
            left, right = np.divmod(keys, max(1, len(label)))
            yield (
                [label[i][0] for i in left],
                [label[i][1] for i in left],
                [label[i][1] for i in right],
                sums.tolist(),
            )
            start = end


def _one_has(rows):
    """What a source's own terms add to its pairs, in either order, and what absent terms add."""
    for langs, names, v, absent, shares, times, others, others_absent in rows:
        for lang, name, terms_kept, p0, p, m, items, q0 in zip(
            langs, names, v, absent, shares, times, others, others_absent
        ):
            there = [i for i, x in enumerate(items) if x != name]
            items = [items[i] for i in there]
            if not items:
                continue
            forth, back = np.zeros((2, len(items)), np.int64)
            if terms_kept:
                q = np.array([q0[i] for i in there], np.int64)
                own, other = np.array([p0], np.int64), np.array(p or [], np.int64)
                forth += terms_kept * _spread(own, q)
                step = max(1, CELLS // len(items))
                for at in range(0, len(other), step):
                    part = other[at : at + step, None]
                    many = np.array(m[at : at + step], np.int64)[:, None]
                    forth += (many * (_spread(part, q) - _spread(own, q))).sum(axis=0)
                    back += (many * (_spread(q, part) - _spread(q, own))).sum(axis=0)
            yield [lang] * len(items), [name] * len(items), items, forth.tolist()
            yield [lang] * len(items), items, [name] * len(items), back.tolist()


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    For sources g and h, shares p and q, shares of absent terms p0 and q0, and f(p, q):
    V f(p0, q0) + sum over g's terms of f(p, q0) - f(p0, q0) + sum over h's of f(p0, q) - f(p0, q0)
    + sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
    """
    sums = "lang string, source string, item string, value bigint"
    entry = F.struct("source", "p", "p0")
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(entry).alias("x")).filter(F.size("x") > 1)
    pieces = by_term.withColumn("begin", F.explode(F.expr(f"sequence(0, size(x) - 1, {SLICE})"))).select(
        "lang",
        "begin",
        F.least(F.size("x"), F.col("begin") + SLICE).alias("end"),
        *[F.col(f"x.{c}").alias(c) for c in ("source", "p", "p0")],
    )
    both = map_rows(pieces, pieces.columns, _both_have, sums)
    histogram = (
        shares.groupBy("lang", "source", "p")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("lang", "source")
        .agg(F.collect_list(F.struct("p", "m")).alias("x"))
    )
    slices = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / OTHERS).alias("slices"))
    salt = F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt")
    others = (
        groups.join(slices, "lang")
        .groupBy("lang", F.pmod(F.xxhash64("source"), "slices").alias("slice"))
        .agg(F.collect_list(F.struct("source", "p0")).alias("o"))
        .select("lang", "o", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    placed = (
        groups.join(histogram, ["lang", "source"], "left")
        .withColumn("salt", salt)
        .join(others, ["lang", "salt"])
        .select(
            "lang",
            "source",
            "v",
            "p0",
            *[F.col(f"x.{c}").alias(c) for c in ("p", "m")],
            F.col("o.source").alias("others"),
            F.col("o.p0").alias("others_p0"),
        )
    )
    one = map_rows(placed, placed.columns, _one_has, sums, size=16)
    return both.unionByName(one).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others
    (part `pair`, an item per other source) and by which terms it stands out from the language
    (part `term`, at most `top`).

    Null texts, languages and sources read as ''. A source without terms, and a language without
    kept terms, have their pairs too (0 if the language has none). Ties go to the smaller item in
    UTF-8 order; repeated rows count as often as they come; an empty table gives no rows; other
    columns are not read. Sums stay within 64 bits for up to two thousand million kept terms of a
    language.
    """
    kept = durable(term_counts(docs, least))
    groups = durable(_groups(docs, kept))
    shares = (
        kept.select("lang", "term", "total", F.explode("entries").alias("x"))
        .select("lang", "term", "total", "x.source", F.col("x.n").alias("count"))
        .join(groups, ["lang", "source"])
        .withColumn("p", _share("count", "n", "v"))
    )
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    f = "((p - q) * (p - q)) div q"
    standing_out = (
        shares.join(whole, "lang")
        .withColumn("q", _share("total", "n_lang", "v"))
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f).alias("value"))
    )
    order = [F.col("value").desc(), F.col("item")]
    ranked = first_per_group(standing_out, ["lang", "source", "part"], order, top, "item", "rank")
    one = W.partitionBy("lang", "source").orderBy(*order)
    pairs = (
        _pairs(groups, shares)
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(one))
    )
    return pairs.unionByName(ranked.withColumn("rank", F.col("rank").cast("int")))
