"""Centroid clustering, source divergence and source mixing against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel.llm import centroids, divergence, mixing

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x string"


def slow_clusters(rows, n, rounds, size):
    good = [(i, [math.floor(Fraction(float(np.float32(c))) * 256) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in good if i is not None)
    cs = [x for _, x in named[:n]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min((d2(x, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = {}
        for _, x in good:
            own.setdefault(nearest(x)[1], []).append(x)
        cs = [[sum(col) // len(own[k]) for col in zip(*own[k])] if k in own else c for k, c in enumerate(cs)]
    return sorted(((i if i is not None else -1, *reversed(nearest(x))) for i, x in good)), cs


def check_clusters(spark, rows, n=6, rounds=3, size=8):
    df = spark.createDataFrame([(i, v, 0, 7, "clash") for i, v in rows], VECTORS).repartition(5)
    got, final = centroids.cluster(df, n, rounds, size)
    want, cs = slow_clusters(rows, n, rounds, size)
    assert final == cs
    fits = lambda d: d if d <= centroids.LONG else None
    assert sorted(((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == sorted(((i, k, fits(d)) for i, k, d in want), key=repr)


def test_clusters_equal_brute_force_with_ties_and_repeats(spark):
    own = random.Random(3)
    rows = [(i, [own.choice([-1.0, -0.5, 0.0, 0.5]) for _ in range(8)]) for i in range(200)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (900, None), (901, [0.5] * 7), (902, [0.5] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [])]
    check_clusters(spark, rows)


def test_clusters_of_huge_components_are_exact(spark):
    own = random.Random(4)
    rows = [(i, [own.choice([3e38, -3e38, 1.5, 2.0**60, -7e20, 0.001]) for _ in range(8)]) for i in range(40)]
    rows += [(100 + i, [16777216.0 + own.randrange(64) for _ in range(8)]) for i in range(60)]
    check_clusters(spark, rows)


def test_close_distances_need_the_exact_step():
    own = np.random.default_rng(5)
    base = own.integers(2**24, 2**25, 64)
    cs = [[int(c) for c in base + own.integers(-3, 4, 64)] for _ in range(12)]
    x = (base + own.integers(-3, 4, (300, 64))).astype(float)
    near = centroids.Assigner(cs)
    assert (near.shortlist(x).sum(axis=1) > 1).any()  # single precision can't tell them apart
    exact = ((x.astype(np.int64)[:, None] - np.array(cs)) ** 2).sum(axis=2)
    got, d = near.nearest(x)
    assert (got == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    far = centroids.Assigner([[0] * 64, [1000] * 64])
    assert (far.shortlist(np.full((5, 64), 3.0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [0.25] * 8)]])
def test_few_or_no_vectors(spark, rows):
    check_clusters(spark, rows)


def test_clusters_through_the_query(spark, tmp_path):
    own = random.Random(6)
    rows = [(i, [own.uniform(-1, 1) for _ in range(64)]) for i in range(150)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op11_centroid_clustering(spark, str(tmp_path)).collect()
    want, cs = slow_clusters(rows, 40, 5, 64)
    inertia = Counter()
    for _, k, d in want:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    assert sorted(tuple(r) for r in got) == sorted((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in want)


# divergence -----------------------------------------------------------------------------------------------------------
def slow_audit(rows, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        terms = [t for t, n in df.items() if n >= min_docs]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            counts[s].update(words)
        whole = sum(counts.values(), Counter())

        def p(c, lang_terms=terms):
            n = sum(c[t] for t in lang_terms)
            return {t: 1 + (10**9 * (c[t] + 2)) // (n + 2 * len(lang_terms)) for t in lang_terms}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in terms), o.encode()) for o in counts if o != s))
            best = sorted(((-f(ps[s][t], q[t]), t.encode()) for t in terms if counts[s][t] > 0 and ps[s][t] > q[t]))[:10]
            out += [(lang, s, part, o.decode(), -v, i) for part, found in (("pair", pairs), ("term", best)) for i, (v, o) in enumerate(found, 1)]
    return sorted(out)


def texts():
    own = random.Random(7)
    words = [f"{w}{e}" for w in "ab Ab été 日本 zebra QUX ß İx 😀 naïve".split() for e in ("", "s", "ed", "ing")]
    rows = [(" ".join(own.choices(words, [1 / (1 + i) for i in range(len(words))], k=own.randrange(60))), own.choice(["en", "en", "de", None, ""]), own.choice(["a", "b", "é", "😀", "z", None])) for _ in range(150)]
    return [*rows, rows[0], rows[0], (None, "en", "silent"), ("", "xx", "one"), ("once only", "xx", "two"), ("!!! 123 \x7f\x00 [a]{b}`c", "en", "a"), ("solo " * 5000, "en", "long")]


def test_audit_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i % 7, t, lang, s, 1, "clash") for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string").repartition(6)
    for least in (10, 1):
        got = sorted(tuple(r) for r in divergence.audit(df, least).collect())
        assert got == slow_audit(rows, least)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_pieces_of_long_texts_lose_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    data = b"Alpha beta;gamma-delta  x " + b"y" * 50 + b" end"
    assert [w for ws in divergence.pieces(data) for w in ws] == data.lower().replace(b";", b" ").replace(b"-", b" ").split()
    assert [w for ws in divergence.pieces(b"") for w in ws] == []


def test_probabilities_of_large_counts_are_exact():
    own = random.Random(8)
    for _ in range(200):
        n = own.randrange(1, 1 << 50)
        v, c = own.randrange(1, 1 << 20), own.randrange(n + 1)
        assert divergence.probability(np.array([c]), np.array([n]), v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


# mixing ---------------------------------------------------------------------------------------------------------------
def level_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """As the task says it: shares by weight, what a cap cuts off shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        part = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * sizes[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mixed(spark, rows):
    df = spark.createDataFrame([(i, t, s, 3, 4.0, "clash") for i, t, s in rows], "doc_id long, text string, source string, size int, key double, name string").repartition(5)
    return mixing.mix(df)


def check_mix(spark, rows):
    got = mixed(spark, rows).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += count(t)
    want, taken = level_targets(sizes), Counter()
    assert sorted((r.doc_id or -1, r.size, r.source or "") for r in got) == sorted((i or -1, count(t), s or "") for i, t, s in rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        epochs = int(want[r.source] / sizes[r.source] + 1e-9) if sizes[r.source] else 0
        assert r.taken >= epochs * r.size  # whole epochs come first
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1 + 1e-6
        part = [r for r in got if r.source == s and r.size and r.taken % r.size]
        assert len(part) <= 1  # all others are taken whole
    return got


def test_mix_meets_its_targets(spark):
    own = random.Random(9)
    rows = [(i, "w\x0bord " * own.choice([0, 1, 5, 300]) + "é\t" * own.randrange(9), own.choices(["a", "b", "c", "é", "😀", None, ""], [60, 1, 9, 9, 9, 9, 3])[0]) for i in range(400)]
    rows += [(None, "x y z", "a"), (None, "x y z", "a"), (7, "same id", "a"), (500, None, "a"), (501, None, "only null"), (502, " \t ", "blank"), (503, "w " * 40000, "b")]
    first = sorted((tuple(r) for r in check_mix(spark, rows)), key=repr)
    assert first == sorted((tuple(r) for r in mixed(spark, rows[::-1]).collect()), key=repr)  # reruns agree


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "s")], [(1, "a b c", "s"), (2, "d", None)]])
def test_small_mixes(spark, rows):
    check_mix(spark, rows)


def test_better_documents_come_first_more_often(spark):
    rows = [(i, "good words here and there " * 20 if i % 2 else "1 2 3 4 5 6 7 8 9 0 " * 10, s) for i in range(3000) for s in ("a",)] + [(9000 + i, "z " * 1000, "b") for i in range(100)]
    got = mixed(spark, rows).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg(F.col("taken") / F.col("size")).alias("rate")).collect()
    rate = {r.good: r.rate for r in got}
    assert rate[1] > rate[0] * 1.05
