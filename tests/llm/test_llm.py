"""Training-data operators against SQL, libraries and brute force, and on odd inputs."""

import collections
import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from moraine.llm import chat, licenses, line_dedup, mixing, quality, queries, sentencepiece_codec, simhash, substring_dedup, topk, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, same, name):
    same(spark, name)


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# Brute force


def brute_substring(docs, window=20):
    seen, out = set(), {}
    for doc_id, text in docs:
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, SMALL).collect()}
    want = brute_substring(texts(spark))
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_substring_dedup_of_periodic_text(spark):
    docs = [(1, "a b " * 30), (2, "x " * 19 + "y"), (3, "x " * 19 + "y z")]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute_substring(docs)


def brute_fingerprint(text, shingle=4):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance):
    label = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = label[a], label[b]
                if x != y:
                    label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def test_simhash_equals_brute_force(spark):
    prints = {i: brute_fingerprint(t) for i, t in texts(spark)}
    label = brute_groups(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}


def test_simhash_links_chains_of_dense_groups(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {}
    for k in range(160):
        x = base[k % 4]
        for b in r.sample(range(64), r.randrange(6)):
            x ^= 1 << b
        prints[k] = x
    rows = [(k, int(np.array([x], np.uint64).view(np.int64)[0])) for k, x in prints.items()]
    entries = spark.createDataFrame(rows, "node long, f0 long").groupBy("f0").agg(F.min("node").alias("node"))
    links = [(r.u, r.v) for r in simhash.links(entries, 1, 6, 6).collect()]
    label = brute_groups(prints, 6)
    assert all(label[u] == label[v] for u, v in links)
    from moraine.llm.components import components

    df = spark.createDataFrame(links, "u long, v long")
    roots = {r.node: r.root for r in components(df).collect()}
    ids = {f: min(k for k, x in prints.items() if x == f) for f in prints.values()}
    assert {k: roots.get(ids[x], ids[x]) for k, x in prints.items()} == label


def brute_similar(docs, shingle=5, similarity=0.8):
    """The smallest doc_id of each document's group, all pairs compared."""
    grams = {i: {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} for i, t in docs for w in [re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()]}
    label = {i: i for i in grams}
    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def altered(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"x{r.random()}"
    return " ".join(words)


def test_one_of_each_similar_group_stays(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    docs = [(k, altered(r, base[k % 12], r.randrange(1, 14))) for k in range(240)] + [(k, f"a short text {k % 5}") for k in range(300, 320)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept, want = {x.doc_id for x in simhash.one_of_each(df).collect()}, set(brute_similar(docs).values())
    # Each pair at the threshold is found with 94 %, nearer ones always; nothing else goes.
    assert kept >= want and len(kept - want) <= 0.05 * (len(docs) - len(want))


def test_one_of_each_leaves_no_link_out(spark):
    # Links at the threshold, most of them beyond the fingerprints' distance, and pairs of one template whose edges a forest of a chunk may lack.
    r = random.Random(11)
    pick = lambda n: [f"w{r.randrange(50_000)}" for _ in range(n)]
    docs = []
    for k in range(150):
        words = pick(95)
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - 10] + pick(10)))]  # 81 of 101 shingles
    template = pick(120)
    for k in range(200, 260):
        words = [*template, *pick(20)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + pick(1)))]
    docs += [(900, "a b"), (901, "A  b"), (902, "a c"), (903, "one two three four five six"), (904, "one two three four five seven")]
    want = set(brute_similar(docs).values())
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in simhash.one_of_each(df).collect()} == want and len(want) < len(docs) - 200


@pytest.mark.parametrize("limit", [50, 10**6])
def test_prefixes_meet_in_blocks(spark, limit):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(120)]
    none = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    rows = [(k, k % 9, len(x), bytearray(simhash.prefix(x, 0.4, *none).tobytes()), bytearray(simhash.parities(x))) for k, x in enumerate(sets)]
    entries = spark.createDataFrame(rows, "node long, label long, size int, prefix binary, odd binary")
    got = [(x.u, x.v) for x in simhash.parities_fit(simhash.crossing(entries, 0.4, limit), entries, 0.4).collect()]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 9 != j % 9 and len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    assert len(got) == len(set(got)) and want and want <= set(got) and all(i % 9 != j % 9 for i, j in got)


def test_pairs_that_share_one_hash_by_chance_do_not_meet(spark):
    # One hash that all sets begin with made 19,900 pairs, which grow with the square of the sets.
    r = np.random.default_rng(6)
    sets = [np.unique(np.append(r.integers(1, 2**62, 60), 0).astype(np.uint64)) for _ in range(200)]
    sets += [np.unique(np.append(x[:-4], r.integers(1, 2**62, 4).astype(np.uint64))) for x in sets[:20]] + [np.array(x, np.uint64) for x in ([1], [1, 2], [5, 6, 7, 8], [5, 6, 7, 8, 9])]
    none = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    rows = [(k, k, len(x), bytearray(simhash.prefix(x, 0.8, *none).tobytes())) for k, x in enumerate(sets)]
    got = {(x.u, x.v) for x in simhash.crossing(spark.createDataFrame(rows, "node long, label long, size int, prefix binary"), 0.8).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert want <= got and len(want) == 21 and len(got) < 40


def test_work_of_the_first_search_does_not_grow_with_the_table():
    both = np.full((64, 64), 0.25) + np.eye(64) / 4
    for n in (10**4, 10**6, 10**8):
        cost, parts = simhash._cheapest(both * n, n, 10)
        bounded = simhash.plan(both * n, n, 10, simhash.WORK)
        assert bounded and (bounded == parts) == (cost <= simhash.WORK * n)
        # Index rows, probes and the pairs that meet by chance, n of them for each entry and part.
        rows = sum(1 + (sum(math.comb(len(b), r) for r in range(t + 1)) - 1) / 2 for b, t in bounded)
        meet = sum(n * sum(math.comb(len(b), r) for r in range(t + 1)) / 2 ** len(b) for b, t in bounded)
        assert rows * simhash.ROW_COST + meet <= simhash.WORK * 1.001


def test_parities_of_large_sets_tell_them_apart(spark):
    r = np.random.default_rng(4)
    whole = np.unique(r.integers(0, 2**63, 6000).astype(np.uint64))
    sets = [whole, np.concatenate((whole[:5500], whole[:500] + np.uint64(1))), np.concatenate((whole[:4500], whole[:1500] + np.uint64(1))), whole[:5000]]
    entries = spark.createDataFrame([(k, len(x), bytearray(simhash.parities(x))) for k, x in enumerate(sets)], "node long, size int, odd binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "u long, v long")
    assert {x.v for x in simhash.parities_fit(pairs, entries, 0.8).collect()} == {1, 3}  # similarities 0.85, 0.6, 0.83


def test_rows_are_told_apart_by_id_and_text(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(9000)}" for _ in range(80)) for _ in range(3)]
    rows = [(4, texts[0]), (4, texts[1]), (4, texts[1]), (7, texts[0]), (None, texts[0]), (None, texts[2]), (8, None), (9, " \n"), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted((str(x.doc_id), x.text or "") for x in simhash.one_of_each(df).collect())
    assert got == sorted([("4", texts[0]), ("4", texts[1]), ("None", texts[2]), ("8", "")])


def packed(prints, key=7):
    ids = np.arange(len(prints))
    return pa.table({"probe": [False], "keys": [np.full(len(prints), key, np.uint64).tobytes()], "prints": [prints.tobytes()], "nodes": [ids.tobytes()]})


def near_copies(n, seed, most=5):
    r = np.random.default_rng(seed)
    out = np.full(n, 0x123456789ABCDEF0, np.uint64)
    for _ in range(most):
        out = np.where(r.random(n) < 0.7, out ^ (np.uint64(1) << r.integers(8, 64, n).astype(np.uint64)), out)
    return np.unique(out)


@pytest.mark.parametrize("hot", [0, 10**9])
def test_hot_values_and_plain_ones_have_the_same_components(monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_PAIRS", hot)
    for seed in range(6):
        prints = near_copies(400, seed, 5 + seed)
        label = brute_groups(dict(enumerate(map(int, prints))), 4)
        edges = simhash._match(packed(prints), 1, 4, 4).to_pylist()
        assert all((int(prints[e["u"]]) ^ int(prints[e["v"]])).bit_count() <= 4 for e in edges)
        assert len(edges) == len(prints) - len(set(label.values()))


def test_dense_groups_take_little_time():
    prints = near_copies(20_000, 1)
    assert len(prints) > 14_000
    began = time.perf_counter()
    edges = simhash._match(packed(prints), 1, 4, 4)
    assert time.perf_counter() - began < 3 and edges.num_rows > 0.99 * len(prints)


def test_large_chunks_are_cut_into_blocks(spark):
    prints = near_copies(500, 2)
    entries = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(prints.view(np.int64))], "node long, f0 long")
    label = brute_groups(dict(enumerate(map(int, prints))), 4)
    from moraine.llm.components import components

    for limit in (50, simhash.CHUNK_ROWS):
        roots = {x.node: x.root for x in components(simhash.links(entries, 1, 4, 4, chunk_rows=limit)).collect()}
        assert {k: roots.get(k, k) for k in label} == label


def test_forest_is_minimal():
    r = random.Random(7)
    for _ in range(60):
        edges = [(r.randrange(9), r.randrange(9), r.randrange(4)) for _ in range(r.randrange(1, 20))]
        edges = [e for e in edges if e[0] != e[1]]
        got = simhash.forest(*(np.array(x, np.int64) for x in (zip(*edges) if edges else ([], [], []))))
        label, cost = {k: k for k in range(9)}, 0
        for a, b, w in sorted(edges, key=lambda e: e[2]):
            if label[a] != label[b]:
                x, y = label[a], label[b]
                label, cost = {k: x if v == y else v for k, v in label.items()}, cost + w
        assert sum(edges[k][2] for k in got) == cost and len(got) == 9 - len(set(label.values()))


def test_long_lines_and_words(spark):
    long = "x" * 1_200_000
    rows = [(1, long), (2, f"{long} y\n{long} y"), (3, " ".join(str(k) for k in range(300_000)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {1: (1, 0), 2: (4, 0), 3: (300_000, 0)}
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_words for r in licenses.scan(df).collect()} == {1: 1, 2: 4, 3: 300_000}
    assert {r.doc_id: (r.n_words, r.n_dup_lines) for r in quality.quality_rules(df).collect()} == {1: (1, 0), 2: (4, 1), 3: (300_000, 0)}
    assert len({r.f0 for r in simhash.near_duplicates(df).collect()}) == 3 and simhash.one_of_each(df).count() == 3


def test_sentencepiece_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    odd = ["", " ", "  two  spaces ", "\n\nlines\n", "▁▁mark ▁", "tab\tand\x00nul", "日本語 ümlaut 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "<s></s><unk>"]
    odd += ["".join(r.choice("ab éß▁ \n🙂日.,1") for _ in range(r.randrange(1, 60))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(1000 + i, t) for i, t in texts(spark)]
    df = spark.createDataFrame(rows + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in sentencepiece_codec.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for k, t in [*rows, (-1, "")]:
        ids = sp.encode(t, add_eos=True)
        assert got[k] == (len(ids), " ".join(map(str, ids)), sp.decode(ids)), repr(t[:80])


def check_lines(docs, got, rare=100, min_chars=20):
    """Holds kept texts against all earlier documents. docs: id and text, ids in order and distinct.

    Looked-up lines stay exactly where no earlier document holds them; a shorter line goes only as part
    of a run that an earlier document holds too, with a rare looked-up line or two of any frequency in it;
    a text of short lines goes as a whole if an earlier one is the same, and only then.
    """
    lines = {i: t.split("\n") for i, t in docs}
    df = collections.Counter(x for ls in lines.values() for x in set(ls) if len(x) >= min_chars)
    holders = collections.defaultdict(list)
    seen, texts = set(), set()
    for i, t in docs:
        mine, kept = lines[i], got[i].split("\n") if got[i] else []
        long = [len(x) >= min_chars for x in mine]
        if not any(long):
            assert got[i] == ("" if t.strip(" \n\t\r\x0b\x0c") and t in texts else t)
        else:
            assert [x for x in kept if len(x) >= min_chars] == [x for x in mine if len(x) >= min_chars and x not in seen]
            may = set()
            for o in {o for x in mine for o in holders[x]}:
                theirs = lines[o]
                for a in range(len(mine)):
                    for b in range(len(theirs)):
                        n = 0
                        while a + n < len(mine) and b + n < len(theirs) and mine[a + n] == theirs[b + n]:
                            n += 1
                        run = mine[a : a + n]
                        if sum(long[a : a + n]) > 1 or any(0 < df[x] <= rare for x in run):
                            may.update(range(a, a + n))
            must = collections.Counter(x for p, x in enumerate(mine) if not long[p] and p not in may)
            short = collections.Counter(x for x in kept if len(x) < min_chars)
            assert not must - short - collections.Counter([] if kept else [""]) and not short - collections.Counter(x for p, x in enumerate(mine) if not long[p])
        for x in set(mine):
            if len(x) >= min_chars:
                holders[x].append(i)
        seen.update(mine)
        texts.add(t)


def test_line_dedup_against_all_earlier_documents(spark):
    docs = sorted(texts(spark))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_lines(docs, {r.doc_id: r.kept_text for r in got})
    assert sum(r.n_removed for r in got) > 0 and all(r.n_lines - r.n_removed == (len(r.kept_text.split("\n")) if r.n_removed < r.n_lines else 0) for r in got)


def test_line_dedup_of_random_documents(spark, monkeypatch):
    r = random.Random(12)
    pool = [f"a line that some documents hold {k}" for k in range(25)] + ["short", "--", ""]
    docs = [(k, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line number {k} {r.random()}" for _ in range(r.randrange(1, 15)))) for k in range(120)]
    docs += [(k, f"a\nb {k % 3}\nc") for k in range(200, 212)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (3, line_dedup.HOT_PAIRS):
        monkeypatch.setattr(line_dedup, "HOT_PAIRS", limit)
        monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", limit)
        for rare in (4, 100):
            check_lines(docs, {x.doc_id: x.kept_text for x in line_dedup.line_dedup(df, rare=rare).collect()}, rare)


@pytest.mark.parametrize("copies", [2, 101, 150])
def test_copies_of_one_line_leave_one(spark, copies):
    for text in ("a document that is a single line of some length", "short"):
        df = spark.createDataFrame([(k, text) for k in range(copies)], "doc_id long, text string")
        got = {x.doc_id: x.kept_text for x in line_dedup.line_dedup(df).collect()}
        assert got.pop(0) == text and set(got.values()) == {""}


def test_line_dedup_deletes_lines_on_many_documents(spark):
    notice, passage = "Subscribe to our letter for more news", " ".join(f"word{k}" for k in range(60))
    docs = [(k, f"the own first line of {k}\n{notice}\nshort {k}\nthe own last line of {k}\n{notice}" if k % 2 else passage) for k in range(240)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == (0, docs[0][1]) and got[1] == (0, docs[1][1])
    assert all(got[k] == ((2, docs[k][1].replace("\n" + notice, "")) if k % 2 else (1, "")) for k in range(2, 240))


def test_doomed_equals_all_common_runs():
    assert sorted(line_dedup.doomed([1, 5, 5, 7], [5, 2, 5, 1], [True] * 4, {1, 5})) == [0, 1, 2]
    r = random.Random(6)
    for _ in range(2000):
        a, b = ([r.randrange(7) for _ in range(r.randrange(14))] for _ in range(2))
        rare, long = {x for x in range(4) if r.random() < 0.3}, [x < 4 for x in a]
        spans = [(i, k) for k in range(1, len(a) + 1) for i in range(k) if any(a[i:k] == b[j : j + k - i] for j in range(len(b)))]
        every = {p for i, k in spans if sum(long[i:k]) > 1 or rare & set(a[i:k]) for p in range(i, k)}
        got = line_dedup.doomed(a, b, long, rare)
        assert len(got) == len(set(got)) and set(got) <= every
        assert {p for p in every if long[p]} <= set(got)
        if any(x in b for p, x in enumerate(a) if long[p] and p not in line_dedup._aligned(a, b, long, rare)):
            assert set(got) == every


def test_no_line_of_an_earlier_document_stays(spark):
    r = random.Random(8)
    pool = [f"a passage that many documents hold {k}" for k in range(30)] + [f"s{k}" for k in range(5)]
    docs = [(k, "\n".join(r.choice(pool) if r.random() < 0.5 else f"the own line {r.random()} of {k}" for _ in range(r.randrange(3, 20)))) for k in range(150)]
    lines = {i: t.split("\n") for i, t in docs}
    for rare in (5, 100):
        got = {x.doc_id: x.kept_text for x in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), rare=rare).collect()}
        seen = set()
        for i in sorted(lines):
            assert [x for x in got[i].split("\n") if len(x) >= 20] == [x for x in lines[i] if len(x) >= 20 and x not in seen]
            seen.update(lines[i])


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    # Unique lines anchor, repeated ones align between them; a moved block keeps the longer order.
    assert line_dedup.patience([0, 1, 0, 2, 0, 3], [9, 1, 0, 2, 8, 0, 3]) == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 6)]
    assert line_dedup.patience([1, 2, 3, 7, 8], [7, 8, 1, 2, 3]) == [(0, 2), (1, 3), (2, 4)]
    assert line_dedup.patience([5, 5, 5], [4, 5, 5, 6]) == []
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(9))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))
        assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def test_top_k_with_ties_and_copies(spark):
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, (300, 5)).astype(float) / 8
    v[50:120] = v[0]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 5), (902, [0.1, None, 0.1, 0.1, 0.1]), (1000, [float("inf")] * 5)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10)
    q = np.floor(v * 1024).astype(int)
    want = []
    for k in range(0, 300, 100):
        best = sorted((-int(q[k] @ q[j]), j) for j in range(300) if j != k)[:10]
        want += [(k, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == want


def targets_by_filling(totals, weights=(3, 1, 2), share=1.5, most=2):
    """Targets in the order of totals: shares by weight, what is above a source's limit shared again."""
    goal, open_, budget = [0.0] * len(totals), set(range(len(totals))), share * sum(totals)
    w = [weights[k % len(weights)] for k in range(len(totals))]
    while open_:
        level = budget / sum(w[k] for k in open_)
        full = {k for k in open_ if w[k] * level > most * totals[k]}
        for k in full or open_:
            goal[k] = most * totals[k] if full else w[k] * level
            budget -= goal[k]
        open_ -= full or set(open_)
    return goal


def check_mix(rows):
    """rows: source, size, source_size, target, taken."""
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(r.size for r in rows if r.source == s) for s in sources}
    for s, goal in zip(sources, targets_by_filling(list(totals.values()))):
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == totals[s] and r.target == pytest.approx(goal) and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - goal) <= max(1, max(r.size for r in mine))


def test_mix_meets_its_targets(spark):
    sources = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source")
    check_mix(queries.op4_mixing(spark, SMALL).join(sources, "doc_id").collect())


def test_mix_of_many_sources(spark):
    r = random.Random(3)
    rows = [(k, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 30))), "en", None if k % 400 == 7 else f"s{k % 1300:04d}", 1) for k in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    check_mix(mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect())


def test_pipeline_stages_follow_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or out.columns == columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, [r for r in out.collect()]
        if name == "line dedup":
            check_lines(sorted((i, t or "") for i, t in before.items()), dict.fromkeys(before, "") | {r.doc_id: r.text for r in after})
        if name == "SimHash near-dedup":
            label = brute_similar([(r.doc_id, r.text or "") for r in docs.collect()])
            assert {r.doc_id for r in after} == set(label.values())
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert {i: sum(r.doc_id == i for r in after) for i in before} == taken
        if name == "SentencePiece":
            assert len(after) == docs.count() and {r.decoded for r in after} == {t.replace("▁", " ") for t in before.values()}
        docs = out


# Odd inputs

LONG = " ".join(str(k % 9973) for k in range(60_000))
ODD = [
    (None, "a row without id", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3), (4, "same text here\nfor two rows of a table", "en", "s", 9),
    (4, "same text here\nfor two rows of a table", "en", "s", 9), (4, "another text with the id of others", "de", "t", 9), (5, LONG, "en", "s", len(LONG)), (6, LONG, "en", "t", len(LONG)), (7, "one", "en", "u", 3),
]
CLASH = ("copy", "f0", "node", "key", "hash", "block", "size", "line", "host", "carried", "bucket", "salt", "_key", "n_words", "words", "component_id", "u", "v")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in CLASH})


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


OPERATORS = {
    "substring": substring_dedup.substring_dedup,
    "lines": line_dedup.line_dedup,
    "pieces": lambda d: sentencepiece_codec.encode_decode(d, model()),
    "mix": mixing.mix,
    "simhash": simhash.near_duplicates,
    "licenses": licenses.scan,
    "quality": quality.quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents_keep_their_rows(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert OPERATORS[name](odd.limit(0)).collect() == []
    assert sorted(map(str, OPERATORS[name](odd).collect())) == sorted(map(str, rows))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_odd_documents_in_stages(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, "")
    out.collect()
    assert k == 4 or out.columns == odd.columns
    assert stage(spark, odd.limit(0), "").collect() == []


def test_odd_results(odd):
    gone = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.substring_dedup(odd).collect()}
    assert gone[(6, 60_000)] == 60_000 and gone[(1, 0)] == 0
    found = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert found[1].f0 == 0 and found[3].component_id == 1 and found[6].component_id == 5
    verdicts = {(r.doc_id, r.n_words): r.kept for r in quality.quality_rules(odd).collect()}
    assert not verdicts[(1, 0)] and verdicts[(5, 60_000)] == verdicts[(6, 60_000)]
    tokens = {r.doc_id: r.n_tokens for r in sentencepiece_codec.encode_decode(odd, model()).collect()}
    assert tokens[1] == tokens[2] == 1


def test_boilerplate_goes_and_clean_documents_stay(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    body = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(k, f"{body(8)}\nSubscribe to our  letter for more news", "en", "h", 1) for k in range(60)]
    rows += [(100, ("Subscribe to our letter for MORE news\n" * 30) + body(5), "en", "h", 1), (101, body(9), "en", "g", 1)]
    got = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame(rows, DOCS), max_repeat_percent=100, carry=("lang",)).collect()}
    assert all(got[k].kept and "Subscribe" not in got[k].clean_text for k in range(60))
    assert not got[100].kept and got[101].kept and got[101].lost_chars == 0


def test_repeated_rows_lose_their_boilerplate_once(spark):
    notice = "Subscribe to our letter for more news"
    body = lambda k: "\n".join(" ".join(f"w{k}x{n}x{j}" for j in range(12)) for n in range(6))
    rows = [(k, f"{body(k)}\n{notice}\n{notice}", "en", "h", 1) for k in range(60)]
    rows += [rows[7]] * 40 + [(None, rows[8][1], "en", "h", 1)] * 30
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS), max_repeat_percent=100, carry=("lang",)).collect()
    assert len(got) == 130 and all(x.lost_chars == 2 * len(notice) and x.kept and notice not in x.clean_text for x in got)


def brute_blocks(text, threshold=0.8):
    """Best containment of each template in any block of the text."""
    found, out = licenses.words(text), {}
    for label, (template, names) in licenses.TEMPLATES.items():
        t = set(licenses.words(template))
        need, width = licenses.shape(template, threshold)
        best = max((len(t & set(w)) for i in range(len(found)) for w in [found[i : i + width]] if set(licenses.words(names)) <= set(w)), default=0)
        if best >= need:
            out[label] = best / len(t)
    return out


def test_licenses_equal_brute_force(spark):
    r = random.Random(5)
    filler = ["software", "the", "of", "license", "copy", "permission", "word", "other", "notice"]
    rows = []
    for k in range(60):
        parts = []
        for label in r.sample(sorted(licenses.TEMPLATES), 2):
            words = licenses.TEMPLATES[label][0].split()
            kept = [w for w in words if r.random() > r.choice((0, 0.1, 0.25))]
            for _ in range(r.randrange(8)):
                kept.insert(r.randrange(len(kept) + 1), r.choice(filler))
            parts += [" ".join(r.choice(filler) for _ in range(r.randrange(40))), "\n * ".join(" ".join(kept[i : i + 9]) for i in range(0, len(kept), 9))]
        rows.append((k, "\n".join(parts)))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases={}).collect()}
    for k, text in rows:
        want = brute_blocks(text)
        best = {}
        for x in got[k].blocks:
            best[x.label] = max(best.get(x.label, 0), x.containment)
            block = " ".join(w.decode() for w in licenses.words(text)[x.word : x.word + x.n_words])
            assert x.label in brute_blocks(block)
        assert best == pytest.approx(want) and got[k].score == pytest.approx(max(want.values(), default=0))
    assert len({x for k, t in rows for x in brute_blocks(t)}) > 8


def test_positional_filter_prunes_only_what_cannot_match():
    index = licenses.Index(licenses.TEMPLATES, {}, 0.8)
    mit = next(t for t in index.templates if t.label == "mit")
    rare = next(w for w, r in index.rank.items() if r == mit.ordered[0])
    calls = []
    index._verified = lambda t, part: calls.append(t.label) or iter(())
    list(index.blocks([rare, *[b"filler"] * 300]))
    assert "mit" not in calls  # a rare word alone is dropped before its words are counted
    list(index.blocks(licenses.words(licenses.TEMPLATES["mit"][0])))
    assert "mit" in calls


def test_position_alone_rejects_before_words_are_shared():
    """Prefix words among enough of the vocabulary's words, of which too few are behind them in the order."""
    index = licenses.Index(licenses.TEMPLATES, {}, 0.8)
    mit = next(t for t in index.templates if t.label == "mit")
    word = {r: w for w, r in index.rank.items()}
    last = sorted(mit.prefix)[-1]
    before = ([r for r in sorted(word) if r < last and r not in mit.place] * mit.need)[: mit.need + 5]
    asked = []
    reaches = licenses.Template.reaches
    licenses.Template.reaches = lambda self, rank, ranks, a, b: asked.append((self.label, b - a >= self.need, reaches(self, rank, ranks, a, b))) or asked[-1][2]
    try:
        list(index.blocks([word[r] for r in before] + [word[last]]))
        lone = [x for x in asked if x[0] == "mit"]
        assert lone == [("mit", True, False)] and len(before) >= mit.need  # long enough, and yet out by its place
        asked.clear()
        r = random.Random(4)
        vocabulary = sorted(word.values())
        for _ in range(40):
            few = r.sample(vocabulary, 25)
            list(index.blocks([r.choice(few) if r.random() < 0.9 else b"filler" for _ in range(400)]))
    finally:
        licenses.Template.reaches = reaches
    out = [x for x in asked if x[1] and not x[2]]
    assert len(asked) > 1000 and len(out) > 50  # of the prefix words with words enough around them these go by position


def test_licenses_find_spread_and_altered_notices(spark):
    wrapped = "\n * ".join(re.findall(r".{1,70}(?:\s|$)", " ".join(licenses.TEMPLATES["mit"][0].split())))
    rows = [
        (1, "x MIT License y\nmit license", "", "", 0), (2, "Permission is hereby granted free of charge to any person obtaining a copy of the software with associated documentation", "", "", 0),
        (3, "nothing here", "", "", 0), (4, "GNU general\npublic LICENSE", "", "", 0), (5, f"/*\n * {wrapped}\n */\nint main;", "", "", 0), (6, "released under the Apache License", "", "", 0),
        (7, "licensed under the GNU General Public License, version 2.0", "", "", 0), (8, None, "", "", 0), (9, "w " * 200_000 + "Released under the MIT License", "", "", 0),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 4, "mit")
    assert got[2].labels == "mit-grant" and 0.8 <= got[2].score < 1 and got[2].base_labels == ""
    assert (got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert got[4].base_labels == "gpl"
    assert got[5].labels == "mit,mit-grant" and got[5].score == 1.0 and got[5].base_labels == ""
    assert got[6].labels == "apache" and "apache" not in got[7].labels.split(",") and got[7].base_labels == "gpl"
    assert got[8].labels == "" and got[8].n_words == 0
    assert got[9].labels == "mit,mit-notice" and (got[9].blocks[0].word, got[9].n_words) == (200_000, 200_005)


def test_chat_snapshots_collapse(spark):
    turns = [("user", "hello"), ("assistant", "hi"), ("user", "more"), ("assistant", "<|im_start|>no")]
    rows = [(c, t, *turns[t]) for c in range(4) for t in range(c + 1)] + [(9, 0, "user", "other"), (9, 0, "user", "other"), (None, 0, None, None), (8, 0, "user", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("n", "c", "x1", "stretch", "piece")})
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 9, None} and got[3].n_turns == 4 and got[9].n_turns == 1
    assert got[3].rendered.count("<|im_start|>") == 4 and "< |im_start|>no" in got[3].rendered
    assert chat.format_chats(df.limit(0)).collect() == []


def test_copies_of_substrings_without_ids_and_many_blocks(spark):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(10, 120))) for _ in range(60)]
    texts = [" ".join([*t.split(), *texts[k - 7].split()[:30]]) if k > 7 and k % 3 == 0 else t for k, t in enumerate(texts)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (None, 50):
        got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in substring_dedup.substring_dedup(df, block_bytes=size).collect()}
        assert got == brute_substring(docs)
    none = spark.createDataFrame([(None, texts[0])] * 3 + [(1, texts[0])], "doc_id long, text string")
    left = sorted((str(x.doc_id), x.n_removed) for x in substring_dedup.substring_dedup(none).collect())
    n = len(texts[0].split())
    assert left == [("1", n), ("None", 0), ("None", n), ("None", n)]


@pytest.mark.parametrize("ids", [[5], [5, 9, 7], [-(2**63), 3], [2**62, 2**62 + 2**32 - 1], [0, 2**32]])
def test_owners_are_packed_whole(ids):
    ids = np.array(ids, np.int64)
    assert substring_dedup._from_offsets(substring_dedup._offsets(ids), len(ids)).tolist() == ids.tolist()


def test_second_fingerprints_are_independent():
    rows = pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["a b c d e f g h i j k l"]})
    block = substring_dedup.Block(rows, 2)
    block.hashes[:] = 0  # as if every window collided
    block.double(np.ones(len(block.left), bool))
    assert len(set(block.second().tolist())) == len(block.second()) == 9


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>\r\n\r\n" * 30_000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "u", ""), (None, "v", big), (5, "w", "x" * 99), (6, "w", "x" * 99), (1, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "n", "refers_to")})
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=100)
    index = warc.read_index(spark, str(tmp_path / "w"))
    got = warc.read_records(index, str(tmp_path / "w")).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    n = len(big.encode())
    assert kinds == sorted([("1", "response", None, n), ("1", "response", None, n), ("2", "revisit", 1, n), ("3", "response", None, 0), ("4", "response", None, 0), ("None", "revisit", 1, n), ("5", "response", None, 99), ("6", "response", None, 99)])
    assert {r.payload for r in got if r.page_id == 1} == {big}
    assert [r.page_id for r in warc.read_records(index.where("page_id = 5"), str(tmp_path / "w")).collect()] == [5]
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_records(warc.read_index(spark, str(tmp_path / "e")), str(tmp_path / "e")).collect() == []


def test_top_k_leaves_parts_out_and_loses_nothing(spark, monkeypatch):
    r = np.random.default_rng(6)
    middle = r.normal(size=(12, 6)) * 4
    v = (middle[r.integers(0, 12, 1500)] + r.normal(size=(1500, 6)) * 0.05).round(3)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(v * 1024).astype(int)
    for sizes in ({"block_rows": 100, "chunk_queries": 7, "sample": 64}, {"block_rows": 40, "sample": 12}, {"sample": 5}):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, 10, **sizes).collect())
        want = [(k, n + 1, j, -s) for k in range(0, 1500, 100) for n, (s, j) in enumerate(sorted((-int(q[k] @ q[j]), j) for j in range(1500) if j != k)[:10])]
        assert got == want
    points, asked = topk.Tree(q.astype(float)), topk.Tree(q.astype(float))
    scored = []
    search = topk.Search(np.arange(1500), np.full(1500, topk.LOW), 10)
    offer = search.offer
    monkeypatch.setattr(search, "offer", lambda rows, scores, ids: (scored.append(scores.size), offer(rows, scores, ids)))
    topk.dual(asked, points, np.arange(1500), search)
    assert sum(scored) < 0.6 * 1500 * 1500  # node pairs are left out


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 100 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (1, [0.0, 1.0]), (100, [])], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "v", "seed", "block", "rank")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(few, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 3 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 1, 0)]


def test_results_are_json_ready(spark):
    row = queries.op6_licenses(spark, SMALL).first().asDict()
    assert json.dumps(row) and set(row) >= {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}


def test_what_a_codec_remembers_is_small():
    from sys import getsizeof

    own = sentencepiece_codec.Codec(sentencepiece_codec.read_model(model()))
    r = random.Random(4)
    for _ in range(200):
        own.encode(" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(1000)))
    size = sum(getsizeof(k) + getsizeof(v) + (sum(map(getsizeof, v)) if isinstance(v, tuple) else 0) for d in (own.known, own.older) for k, v in d.items())
    assert own.known and size < 25_000_000


def test_tested_pairs_are_numbers_and_no_single_character_is_tested():
    import sentencepiece

    own, sp = sentencepiece_codec.Codec(sentencepiece_codec.read_model(model())), sentencepiece.SentencePieceProcessor(model_file=model())
    r = random.Random(5)
    words = ["".join(r.choices(["tion", "the", "qu", "é", "z", "x", "ß", "able", "%", "I", "日", "\n"], k=r.randrange(1, 12))) for _ in range(3000)]
    for _ in range(2):
        for w in words:
            assert own.encode(w)[0].decode() == " ".join(map(str, sp.encode(w, add_eos=True)))
        assert own.compatible and all(isinstance(p, int) and own.sizes[p % len(own.names)] > 1 for p in own.compatible)
        before = own.compatible
        own.rest()
        own.wake()
        assert own.compatible == before
