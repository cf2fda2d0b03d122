"""Hard negatives, phrases and MinHash groups against brute force, and on odd inputs."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import minhash, negatives, phrases, queries

SMALL = "/root/testdata/sf0.001"


# MinHash groups


def brute_groups(docs, shingle, percent):
    """(n_shingles, component) by the place of each document, all pairs held against each other."""
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(len(sets[k]), least[find(k)]) for k in range(len(docs))]


def groups(spark, docs, shingle=3, percent=85):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle, percent).collect())


def test_minhash_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, c, d == c) for (d, _), (n, c) in zip(docs, brute_groups(docs, 3, 85))}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op13_minhash(spark, SMALL).collect()}
    assert got == want and any(c != d for d, (_, c, _) in want.items())


@pytest.mark.parametrize("block", [4096, 40])
def test_minhash_of_families_at_all_similarities(spark, monkeypatch, block):
    """Near copies of long and short texts, chained and borderline; small blocks cut every group."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng = random.Random(5)
    docs = []
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 30, 120, 400]))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(max(2, len(words) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append((1000 - len(docs), " ".join(words)))
    want = collections.Counter((d, n, c, d == c) for (d, _), (n, c) in zip(docs, brute_groups(docs, 3, 85)))
    assert groups(spark, docs) == want


def test_minhash_of_odd_rows(spark):
    long = " ".join(f"w{k % 7001}" for k in range(200_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, long), (8, long.upper()), (9, long + " z"), (None, "a b c"), (None, "only here"), (6, "another text of id six"), (6, "a b c")]
    got = groups(spark, docs)
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1  # empty sets link with nothing
    assert got[(4, 1, 4, True)] == got[(5, 1, 4, False)] == 1
    assert got[(6, 1, 6, True)] == 2 and got[(None, 1, 6, False)] == 1  # rows that repeat; a row without id follows its copies
    assert got[(None, 1, None, True)] == 1 and got[(6, 3, 6, True)] == 1
    assert got[(7, 7001, 7, True)] == got[(8, 7001, 7, False)] == 1 and sum(v for k, v in got.items() if k[2] == 7) == 3
    assert sum(got.values()) == len(docs) and not groups(spark, [])
    df = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, node long, regs long")
    assert minhash.near_duplicates(df).count() == 1


def test_registers_agree_as_often_as_sets_are_similar():
    """Also for sets of less shingles than buckets; agreement by chance of the compression is as corrected."""
    rng = np.random.default_rng(3)
    for size in (6, 20, 400):
        same = []
        for _ in range(400):
            h = rng.integers(0, 2**64, size + 2, dtype=np.uint64)
            a, b = minhash.registers([np.sort(h[:-1]), np.sort(h[1:])])
            same.append((a == b).mean())
        assert abs(np.mean(same) - size / (size + 2)) < 0.02
    n = 20_000
    sets = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(200)]
    regs = minhash.registers(sets)
    by_chance = np.mean([(regs[k] == regs[k + 1]).mean() for k in range(199)])
    assert by_chance < 3 / (1 << minhash.MANTISSA)
    assert minhash.compressed(np.array([2**63, 2**63 + 2**62, 1, 0], np.uint64)).tolist() == [0, 1 << (minhash.MANTISSA - 1), 53 << minhash.MANTISSA, 53 << minhash.MANTISSA]


# Hard negatives


def brute_negatives(rows, is_anchor, scale=256):
    rows = [(i, lab, np.floor(scale * np.array(v, float)).astype(int).tolist()) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for anchor in sorted({i for i, *_ in rows if is_anchor(i)}):
        _, label, v = min(r for r in rows if r[0] == anchor)
        scored = sorted((-dot(v, x), i, lab) for i, lab, x in rows if i != anchor)
        for positive, p in [(i, -s) for s, i, lab in scored if lab == label][:5]:
            fits = [(-s, i) for s, i, lab in scored if lab != label and 30 * p <= 100 * -s <= 90 * p][:10]
            out.update((anchor, positive, k + 1, i, p, s) for k, (s, i) in enumerate(fits))
    return out


def mined(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    out = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    return collections.Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def test_negatives_equal_brute_force_on_clusters_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 10))
    rows = [(k, int(rng.integers(3)), (centres[k % 6] + 0.4 * rng.normal(size=10)).astype(np.float32).tolist()) for k in range(240)]
    rows += [(k, 1, rows[0][2]) for k in range(300, 360)]  # copies: ties
    rows += [(k, 2, [0.0] * 10) for k in range(400, 405)] + [(405, 2, [-x for x in rows[0][2]])]
    rows += [(500, None, rows[1][2]), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")] * 10), (504, 1, [float("inf")]), (None, 1, rows[2][2]), (505, 0, [1.0, 2.0]), (506, 0, []), (400, 0, rows[3][2])]
    got = mined(spark, rows, 10)
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_negatives_of_small_blocks_empty_tables_and_one_label(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, 0 if k % 3 else 4, rng.normal(size=7).astype(np.float32).tolist()) for k in range(90)]
    monkeypatch.setattr(negatives, "CELLS", 50)
    assert mined(spark, rows, 7) == brute_negatives(rows, lambda i: i % 7 == 0)
    assert not mined(spark, [], 7) and not mined(spark, [(0, 1, [1.0])], 7)
    assert not mined(spark, [(k, 1, [1.0, float(k)]) for k in range(9)], 2)  # no other label


def test_residual_bounds_hold_and_leave_rows_out():
    """No score is outside its bounds, and most rows are left out before their vectors are read."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 64))
    points = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None])
    books = negatives.codebooks(points[:1500])
    codes, left = negatives.coded(points, books)
    rows = object.__new__(negatives.Rows)
    rows.ids, rows.labels, rows.points, rows.codes, rows.left = np.arange(3000), np.zeros(3000, int), points, codes, left
    rows.size = negatives.norms(points) + negatives.norms(left)
    low, high = rows.bounds(points[:50], books)
    score = points[:50] @ points.T
    assert (low <= score).all() and (score <= high).all()
    other = rows.ids[None, :] != np.arange(50)[:, None]
    reach = high >= negatives.kth(low, other, 5)[:, None]
    assert (reach & other).mean() < 0.15


# Phrases


def brute_phrases(docs, least=10, top=2000):
    import re

    f = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        candidates = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items() if len(p) == 2 and len(q) == 3):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}
    return out


def collocated(spark, docs, **kw):
    df = spark.createDataFrame(docs, "lang string, text string")
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **kw).collect()}


@pytest.mark.parametrize("share", [4096, 20])
def test_phrases_equal_brute_force(spark, monkeypatch, share):
    """Overlaps, pieces, languages, capitals, ties, rare words; with a small share nearly all prefixes are split."""
    monkeypatch.setattr(phrases, "TASK_POINTERS", 500)
    monkeypatch.setattr(phrases, "SHARE", share)
    rng = random.Random(8)
    words = ["new", "York", "city", "the", "of", "é", "ß", "a", "b"] + [f"r{k}" for k in range(300)]
    docs = []
    for k in range(250):
        text = "".join(rng.choice(words[: rng.choice([9, 309])]) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(60))
        docs.append((rng.choice(["en", "de", None, "", "und"]), text + " x x x x x the same The same"))
    got = collocated(spark, docs)
    assert got == brute_phrases(docs) and len(got) > 50
    assert collocated(spark, docs, least=12, top=5) == brute_phrases(docs, 12, 5)


def test_phrases_of_odd_rows(spark):
    assert collocated(spark, []) == set() and collocated(spark, [(None, None), ("en", ""), ("en", " ,;\n")]) == set()
    docs = [("en", "p q " * 50_000), ("fr", None)]
    assert collocated(spark, docs) == brute_phrases(docs)
    df = spark.createDataFrame([("en", "k l m " * 12, 1, 2)], "lang string, text string, h1 long, task long")
    assert phrases.collocations(df).count() == len(brute_phrases([("en", "k l m " * 12)]))


def test_scores_are_exact_past_64_bits(spark):
    """The expression itself, with counts whose products need 30 digits."""
    from pyspark.sql import functions as F

    a, left, right = 4_000_000_007, 5_000_000_021, 9_000_000_011
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("f1"), F.lit(right).alias("f2"))
    got = row.select(phrases.score("f1", "f2").alias("s")).first().s
    assert got == 10**6 * a * a // (left * right)
