"""Ranked search, vector search and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyboard.llm import lexical, nearest, prefix_trie

# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranked(docs, items, best=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, length = len(held), sum(h[2] for h in held)
    holding = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, counts, n in held:
            m, score = 75 + 25 * n * n_docs // length, 0
            for t in terms(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * (10**9 * counts[t] // (1000 * counts[t] + 12 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block,best", [(8192, 2000, 20), (7, 3, 4), (64, 2000, 1)])
def test_ranked_search(spark, docs, corpus, monkeypatch, shard, block, best):
    monkeypatch.setattr(lexical, "STEP", 2)
    texts = [r[1] for r in corpus]
    items = [(i, texts[i * 5 % 60]) for i in range(9)] + [(50, "Ab3! ab3 AB3"), (51, ""), (52, None), (53, "nowhere"), (53, "zz"), (50, "Ab3! ab3 AB3")]
    items.append((54, texts[-7] if texts[-7] else " ".join(t for t in texts if t)))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical.ranked(docs, asked, best, shard, block).collect()]
    assert sorted(got, key=repr) == brute_ranked([(r[0], r[1]) for r in corpus], items, best)


def test_ranked_search_odd_rows(spark, odd, none):
    asked = odd.select(F.lit(1).alias("item_id"), F.lit("same a text").alias("text"), F.lit(0).alias("rank"))
    got = [tuple(r) for r in lexical.ranked(odd, asked).collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(got, key=repr) == brute_ranked(rows, [(1, "same a text")])
    assert None in [r[2] for r in got]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(none, asked).count() == 0 and lexical.ranked(odd, empty).count() == 0


def test_ranked_search_reads_from_the_top_only():
    """Lists are left as soon as nothing further down can matter."""
    n = 4000
    doc = np.arange(n)
    first = np.array([0, n, n + 3])
    impact = np.concatenate([np.arange(n, 0, -1), [10**7, 10**6, 10**5]])
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append((key.start, key.stop))
            return super().__getitem__(key)

    lists = lexical.Lists(first, np.concatenate([doc, [5, 6, 7]]).view(Watched), impact)
    found, scores = lexical.search(lists, n, np.array([0, 1]), np.array([1, 1]), 3, 0)
    assert set(np.asarray(found).tolist()) == {5, 6, 7} and sorted(scores.tolist()) == [10**5 + n - 7, 10**6 + n - 6, 10**7 + n - 5]
    assert max(stop for start, stop in reads if start < n) < n / 4


# Prefix trie


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = Counter(k[:-1] for k in members if k)
    below = {k: [m for m in members if m[: len(k)] == k] for k in members}
    out = []
    for k, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if whole[c] == k)))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below[k] if m)
        out.append((min(held), len(k), min(members[k[:-1]]) if k else None, len(held), children[k],
                    sum(not children[m] for m in below[k]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-9, 60), n):
        long = 40 if rng.random() < 0.1 else 9
        for turn in range(rng.randrange(1, long)):
            text = rng.choice(["é漢", "b", "", None, "long text"]) if rng.random() < 0.2 else f"t{turn % 2}"
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["u", "u", "u", None]), text))
    return rows + rows[:3] + [(None, 0, "u", "lost"), (None, None, None, None)]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,fan,block,limit", [(1, 4096, 4096, 1000), (2, 2, 3, 1), (3, 3, 2, 2)])
def test_trie(spark, seed, fan, block, limit):
    rows = talks(seed, 40)
    df = spark.createDataFrame(rows, TALK).withColumns({c: F.lit(7) for c in ("n", "rep", "depth", "place", "h")})
    got = [tuple(r) for r in prefix_trie.trie(df, fan, block, limit).collect()]
    assert sorted(got) == brute_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "u", f"line {t}") for c in range(300) for t in range(3)] + [(1000, t, "u", f"line {t}") for t in range(120)]
    got = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TALK), 16, 32, 8).collect()]
    assert sorted(got) == brute_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TALK)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], TALK)).count() == 0


def test_queue_spills_and_keeps_the_order():
    rng = random.Random(5)
    queue, held, got = prefix_trie.SpillingQueue(4), [], []
    for i in range(2000):
        entry = (rng.randrange(50), *[0] * 7, i)
        if held and rng.random() < 0.45:
            assert queue.peek() == min(held)
            got.append(queue.pop())
            held.remove(got[-1])
        else:
            queue.push(entry)
            held.append(entry)
            assert len(queue.held) <= 4
    assert queue.spilled > 100
    while queue.peek() is not None:
        assert queue.peek() == min(held)
        held.remove(queue.pop())
    assert not held


# Nearest neighbours


def brute_near(rows, best=20):
    held = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            held.setdefault(i, []).append(np.array(v, float))
    sizes = Counter(len(v) for many in held.values() for v in many)
    dim = max(sizes, key=lambda s: (sizes[s], s), default=0)
    held = {i: kept for i, many in held.items() if (kept := [v for v in many if len(v) == dim])}
    out = {}
    for q in held:
        if math.fmod(q, 20) == 0:
            scores = sorted((-max((a * b).sum() for a in held[q] for b in held[i]), i) for i in held if i != q)
            out[q] = [(i, -s) for s, i in scores[:best]]
    return out


def vectors_of(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim)) * 3
    return [(i, (centres[i % 6] * (i % 2) + rng.standard_normal(dim) * (1 + i % 3)).tolist()) for i in range(n)]


VECTOR = "vec_id long, embedding array<double>"


def found_near(df, **how):
    out = {}
    for q, rank, i, s in nearest.search(df, df.where("vec_id % 20 = 0"), **how).collect():
        out.setdefault(q, []).append((rank, i, s))
    for got in out.values():
        got.sort()
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
    return {q: [(i, s) for _, i, s in got] for q, got in out.items()}


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 60)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rows = vectors_of(3, 1500)
    rows += [(5000 + i, rows[40][1]) for i in range(400)]  # a hot vector: ties by id
    df = spark.createDataFrame(rows, VECTOR).repartition(6)
    got, want = found_near(df), brute_near(rows)
    assert set(got) == set(want)
    held = dict(rows)
    for q, found in got.items():
        assert all(abs(s - (np.array(held[q]) * np.array(held[i])).sum()) < 1e-9 for i, s in found) and len(found) == 20
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 20 * len(want)
    assert [i for i, _ in got[40]] == [i for i, _ in want[40]]  # copies in the home list, by id
    # Without a limit on lists and deviations the search is exact.
    monkeypatch.setattr(nearest.scan, "__defaults__", (20, 16, 1e9, None))
    whole = found_near(df, target=2.0)
    assert {q: [i for i, _ in f] for q, f in whole.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_nearest_odd_rows(spark):
    rows = vectors_of(5, 45, 5)
    bad = [(None, [1.0] * 5), (100, None), (120, []), (140, [0.0] * 5), (160, [1.0, None, 1.0, 1.0, 1.0]), (180, [1.0, math.nan, 0, 0, 0]),
           (200, [math.inf, 0, 0, 0, 0.0]), (220, [1.0, 2.0]), (20, rows[20][1]), (20, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, rows[7][1]), (-20, rows[3][1])]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows + bad], VECTOR)
    df = df.withColumns({c: F.lit("x") for c in ("list", "score", "rank", "part", "label")})
    got, want = found_near(df, target=2.0), brute_near(rows + bad)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.5])], VECTOR)
    assert found_near(few) == {0: [(2, 1.25), (1, 0.75)]}
    assert found_near(few.where("vec_id = 0")) == {} and found_near(few.where("vec_id > 9")) == {}


def test_scan_abandons_pairs_early():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((6000, 128))
    queries = vectors[:8] + 0.3 * rng.standard_normal((8, 128))
    for i in range(8):  # twenty near ones for each query
        vectors[100 + 20 * i : 120 + 20 * i] = queries[i] + 0.3 * rng.standard_normal((20, 128))
    rotation, _ = np.linalg.qr(rng.standard_normal((128, 128)))
    read = []
    none = np.full(8, -np.inf)
    row, ids, scores = nearest.scan(vectors, np.arange(6000), queries, np.full(8, -1), none, rotation, read=read)
    whole = queries @ vectors.T
    for i in range(8):
        want = np.argsort(-whole[i], kind="stable")[:20]
        assert len(set(ids[row == i]) & set(want)) >= 19
    assert sum(read) < 0.6 * 6000 * 8 * 128
