"""Source divergence, nearest rows and fill-in-middle against plain forms and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from ebbtide.llm import fill_in_middle as fim
from ebbtide.llm import nearest_hashing as near
from ebbtide.llm import source_divergence as apart
from ebbtide.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# Fill in middle


def test_units_are_those_of_the_pattern():
    random.seed(2)
    texts = ["".join(random.choices("aZz@[`{AÿéЖ日😀\x00 \n\x7f-", k=random.randrange(40))) for _ in range(2000)]
    texts += ["", "a" * 8, "a" * 16, "\x00" * 8, "日" * 8, "ab, é" * 100_000]
    units = fim.Units([t.encode() for t in texts])
    assert units.counts().tolist() == [len(UNIT.findall(t)) for t in texts]
    which = np.array([random.randint(0, n) for n in units.counts()])
    for text, k, end in zip(texts, which, units.ends(which)):
        assert text.encode()[:end].decode() == "".join(UNIT.findall(text)[:k])


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ODD = [None, "", " ", "a", "日本語 text, é <S", "with <P> in it", "x<M", "<<S", "S>", "\x00\x00a\x00", "😀" * 9, "﻿a\r\n"]


def test_fill_in_middle(spark):
    rows = [(i, ODD[i % len(ODD)], "en", "a") for i in range(20 * len(ODD))]
    rows += [(None, "no id here", None, None), (7, "again", "en", "a"), (7, "again", "en", "a")]
    rows += [(-12, "long one, " * 500_000, "en", "a")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("form", "output", "h1", "n")})
    made = fim.fill_in_middle(docs)
    want = sorted((plain_fim(i, t) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    digests = fim.fill_in_middle_digests(docs).collect()
    sha = [hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows]
    assert Counter((r["doc_id"], r["restored_sha256"]) for r in digests) == Counter(zip([r[0] for r in rows], sha))
    assert fim.fill_in_middle_digests(docs.limit(0)).count() == 0


# Source divergence


def plain_divergence(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r[1:]) for r in rows]
    found = [(lang, source, Counter(TERM.findall(_lower(text)))) for text, lang, source in rows]
    frequency, counts = Counter(), defaultdict(Counter)
    for lang, source, own in found:
        frequency.update((lang, t) for t in own)
        counts[lang, source].update(own)
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for g, t in frequency if g == lang and frequency[g, t] >= least)
        own = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        share = {}
        for s, c in own.items():
            total = sum(c.values()) + len(kept)
            share[s] = {t: 1 + math.floor(Fraction(10**9 * (c[t] + 1), total)) for t in kept}
        for s in own:
            if s is None:
                continue
            spread = {
                x: sum((share[s][t] - share[x][t]) ** 2 // share[x][t] for t in kept)
                for x in own
                if x not in (s, None)
            }
            p, q = share[s], share[None]
            best = {t: (p[t] - q[t]) ** 2 // q[t] for t in kept if own[s][t] and p[t] > q[t]}
            for part, values, limit in (("pair", spread, None), ("term", best, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def divergence_rows():
    random.seed(5)
    words = [*"the a of and to É ÉÉ naïve 日本 😀 x_y Don't K".split(), "ſ", "ﬀ"]
    rows = [
        (i, " ".join(random.choices(words, k=random.randrange(1, 30))), random.choice("ab"), random.choice("uvwxyz"))
        for i in range(200)
    ]
    rows += [(1000 + i, "copied text with The copied words", "a", random.choice("uvw")) for i in range(90)]
    rows += [(None, None, None, None), (2, "", "a", "empty"), (3, "alone", "c", "one"), (4, "alone", "c", "two")]
    return rows + [(5, "1 2 3", "b", None), (6, "word " * 50_000, "a", "u"), (7, "x y z", None, "u")]


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, monkeypatch, small):
    if small:  # several pieces of a term's sources and of a language's
        for name in ("SLICE", "OTHERS"):
            monkeypatch.setattr(apart, name, 2)
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("item", "value", "p", "rank", "key")})
    have = sorted(tuple(r) for r in apart.source_divergence(docs.repartition(5), top=7).collect())
    assert have == plain_divergence(rows, top=7)
    assert {r[:3] for r in have} >= {("c", "one", "pair"), ("", "u", "pair"), ("a", "empty", "pair")}
    assert apart.source_divergence(docs.limit(0)).count() == 0


def test_pieces_of_pairs_and_counts_add_up(monkeypatch):
    """What Python workers hand on piece by piece, made with pieces of a few cells and texts."""
    random.seed(6)
    sources = [chr(97 + i) for i in range(9)]
    entries = [sorted(random.sample(sources, random.randrange(2, 9))) for _ in range(40)]
    batch = (
        ["x", "y"] * 20,
        [0] * 40,
        [len(e) for e in entries],
        entries,
        [[random.randrange(1, 10**9) for _ in e] for e in entries],
        [[7 + ord(s) for s in e] for e in entries],
    )
    bags = (["x"] * 9, [f"{s} é {s} b" for s in sources], [[{"source": s, "n": 2}, {"source": "z", "n": 1}] for s in sources])

    def added(function, rows, keys):
        sums = Counter()
        for out in function([rows]):
            for row in zip(*out):
                for i, v in enumerate(row[keys:]):
                    sums[*row[:keys], i] += v
        return sums

    pairs, counts = added(apart._both_have, batch, 3), added(apart._counted, bags, 3)
    monkeypatch.setattr(apart, "CELLS", 5)
    monkeypatch.setattr(apart, "CHARACTERS", 1)
    assert (pairs, counts) == (added(apart._both_have, batch, 3), added(apart._counted, bags, 3))
    assert counts["x", "z", "é", 0] == 9 and counts["x", "a", "a", 0] == 4 and counts["x", "a", "a", 1] == 2


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_terms_of_a_text_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(apart, "PIECE", piece)
    for text in ("", "  ", "one", "The the, É日本x 1a-b  " * 50, "x" * 40, "é" * 40, " lead and trail "):
        want = Counter(t.encode() for t in TERM.findall(_lower(text)))
        assert apart.terms(text) == want


def test_one_row_for_copies_of_a_text(spark):
    rows = divergence_rows()
    texts = apart.collapsed(spark.createDataFrame(rows, DOCS)).collect()
    assert len(texts) == len({(lang or "", text or "") for _, text, lang, _ in rows})
    copied = next(r for r in texts if r["text"].startswith("copied"))
    assert sum(x["n"] for x in copied["sources"]) == 90 and len(copied["sources"]) == 3


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**11, 10**12, 5), (3, 4, 1), (0, 0, 0)], "c bigint, n bigint, v bigint")
    got = [r[0] for r in df.select(apart._share("c", "n", "v")).collect()]
    assert got == [1 + 10**9 * (10**11 + 1) // (10**12 + 5), 1 + 10**9 * 4 // 5, None]


# Nearest rows

VECTORS = "vec_id bigint, embedding array<float>"


def plain_nearest(rows, step, nearest):
    """Rows with exact scores; `rows` have finite, nonzero vectors."""
    out = []
    for i, (own, q) in enumerate(rows):
        if own is None or own % step:
            continue
        scored = [
            (-(np.array(q) * np.array(v)).sum(), math.inf if x is None else x)
            for j, (x, v) in enumerate(rows)
            if j != i and len(v) == len(q)
        ]
        out += [(own, k, x, s) for k, (s, x) in enumerate(sorted(scored)[:nearest], 1)]
    return sorted(out, key=repr)


def test_few_rows_are_searched_exactly(spark):
    random.seed(1)
    good = [(i, [float(random.randrange(-4, 5)) * 10 ** (i % 3) for _ in range(4)]) for i in range(120)]
    good = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in good]
    good += [(40, good[40][1]), (3, good[60][1]), (3, good[60][1]), (None, good[60][1])]  # repeated rows and ties
    good += [(200 + i, [1.0, float(i)]) for i in range(0, 21, 10)]  # another length
    bad = [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0])]
    bad += [(480, [float("nan"), 1.0, 0.0, 0.0]), (500, [float("inf"), 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(good + bad, VECTORS).withColumns({c: F.lit(1) for c in ("row", "score", "dim", "cell")})
    got = near.nearest_rows(frame.repartition(4), step=20, nearest=5).collect()
    have = sorted(((r[0], r[1], math.inf if r[2] is None else r[2], -r[3]) for r in got), key=repr)
    assert have == plain_nearest(good, 20, 5)
    assert sum(r[0] == 40 for r in have) == 10 and sum(r[0] == 200 for r in have) == 2
    assert near.nearest_rows(frame.limit(0), step=20).count() == 0


def clusters(spark, many=3000, dim=24):
    random_ = np.random.default_rng(4)
    centres = random_.standard_normal((60, dim))
    vectors = centres[random_.integers(0, 60, many)] + 0.3 * random_.standard_normal((many, dim))
    vectors[: many // 3] = centres[0] + 0.01 * random_.standard_normal((many // 3, dim))  # a hot bucket
    vectors *= random_.choice([0.5, 1.0, 6.0], many)[:, None]  # norm classes
    vectors = vectors.astype(np.float32).astype(float)
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)


def test_recall_where_buckets_are_tiled(spark, monkeypatch):
    for name, value in (("TILE", 64), ("HELD", 2000), ("BUCKET", 32)):
        monkeypatch.setattr(near, name, value)
    vectors, frame = clusters(spark)
    base = near.prepared(frame)
    model = near.fit_index(base, base.filter("vec_id % 20 = 0"))
    assert len(model) > 1 and any(c.cuts > 1 for c in model)
    got = near.nearest_rows(frame, step=20).collect()
    have = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        have[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, len(vectors), 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        assert all(scores[v] == s for v, s in have[q])
        assert have[q] == sorted(have[q], key=lambda x: (-x[1], x[0])) and len(have[q]) == 20
        order = np.lexsort((np.arange(len(vectors)), -scores))
        hit += len({v for v, _ in have[q]} & set(order[order != q][:20].tolist()))
    assert hit >= 0.9 * 20 * len(range(0, len(vectors), 20))


def test_short_results_are_filled_from_all_rows(spark, monkeypatch):
    """A query far from everything, whose buckets hold next to nothing."""
    monkeypatch.setattr(near, "BUCKET", 8)
    monkeypatch.setattr(near, "fit_index", lambda base, *_: [near.NormClass(24, k, 3000, s, 12, 1) for k, s in
        [tuple(r) for r in base.groupBy("norm_class").agg(F.max("norm")).collect()]])
    vectors, frame = clusters(spark)
    got = near.nearest_rows(frame, step=100).groupBy("query_id").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {20}


def test_probes_come_in_order_of_cost():
    random_ = np.random.default_rng(0)
    steps = random_.uniform(-2, 2, 6)
    keys = list(near.probe_order(steps, 300))
    assert len(keys) == len(set(keys)) == 300 and keys[0] == near.bucket(steps)

    def cost(key):
        moved = np.frombuffer(key, np.int16) - np.floor(steps)
        part = steps - np.floor(steps)
        return sum(p**2 if m < 0 else (1 - p) ** 2 if m > 0 else 0 for m, p in zip(moved, part))

    costs = [cost(k) for k in keys]
    assert np.all(np.diff(costs) >= -1e-12)
    assert len(list(near.probe_order(np.zeros(0), 10))) == 1


def test_recall_on_the_given_vectors(spark):
    frame = table(spark, str(TESTDATA / "sf0.1"), "embeddings")
    got = {(r["query_id"], r["vec_id"]) for r in near.nearest_rows(frame, step=20).collect()}
    rows = frame.orderBy("vec_id").collect()
    vectors = np.array([r["embedding"] for r in rows])
    true = set()
    for q in range(0, len(rows), 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        true |= {(rows[q]["vec_id"], rows[i]["vec_id"]) for i in np.argsort(-scores)[:20]}
    assert len(got & true) >= 0.9 * len(true)
