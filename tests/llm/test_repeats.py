import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrace.llm import phrases, suffixes
from terrace.llm.minhash import near_duplicates, shingle_sets, signatures
from terrace.llm.suffixes import common, dedup_bytes, merge_runs, read_run, write_run

from .conftest import edge_rows, prose


def test_merging_runs_keeps_order_and_prefixes():
    r = random.Random(1)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 30))) for _ in range(k)]
        coded = [write_run([(s, (b"left", 1, i, 2, 3, 4)) for s in run]) for i, run in enumerate(runs)]
        merged = list(merge_runs([read_run(c) for c in coded]))
        assert [m[1] for m in merged] == sorted(s for run in runs for s in run)
        before = None
        for n, s, payload in merged:
            assert payload[0] == b"left"
            if before is not None:
                assert n == common(before, s) == next((i for i in range(min(len(before), len(s))) if before[i] != s[i]), min(len(before), len(s)))
            before = s


def brute_bytes(rows, length):
    """Of each row (a document): bytes, removed, spans, hash of the rest."""
    counts = Counter(t[p : p + length] for t in rows for p in range(len(t) - length + 1))
    out = []
    for t in rows:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        gone = np.cumsum(edge[: len(t)]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_words(rows, length):
    """rows: (id, text). Equal rows are one document."""
    first = {}
    cut = sorted({(i, t): t.split() for i, t in rows}.items(), key=lambda x: x[0][0])
    for (i, t), w in cut:
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (i, t, p))
    out = {}
    for (i, t), w in cut:
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] != (i, t, p):
                gone |= set(range(p, p + length))
        out[i, t] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return Counter(out[i, t] for i, t in rows)


def drawn(seed, n=60):
    """Documents with passages in common, text that repeats itself, and copies."""
    r = random.Random(seed)
    stock = [prose(100 + i, r.randint(20, 60)) for i in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(1000 * seed + 10 * i + j, r.randint(1, 40)) if r.random() < 0.6 else r.choice(stock)[r.randint(0, 20) :] for j in range(r.randint(1, 5))]
        if r.random() < 0.1:
            parts.append("la " * r.randint(50, 150))
        rows.append(" ".join(parts))
    return rows + rows[:5]


@pytest.mark.parametrize("most", [1000, 2])
@pytest.mark.parametrize("bytewise", [200, 0])
def test_suffix_dedup_is_exact(spark, most, bytewise, monkeypatch):
    monkeypatch.setattr(suffixes, "BYTEWISE", bytewise)
    texts = drawn(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in dedup_bytes(df, length=60, core=20, most=most).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes([t.encode() for t in texts], 60)


@pytest.mark.parametrize("block", [40_000, 150])
@pytest.mark.parametrize("automaton", [1_000_000, 100])
def test_phrase_dedup_is_exact(spark, block, automaton):
    texts = drawn(2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Counter(tuple(r)[1:] for r in phrases.dedup_phrases(df, length=10, core=4, block=block, automaton_words=automaton).collect())
    assert got == brute_words([(i, t.encode()) for i, t in enumerate(texts)], 10)


@pytest.mark.parametrize("bytewise", [200, 0])
def test_windows_that_occur_again(monkeypatch, bytewise):
    monkeypatch.setattr(suffixes, "BYTEWISE", bytewise)
    r = random.Random(4)
    held = [(bytes(r.choice(b"ab") for _ in range(r.randint(5, 30))), r.randint(1, 5), 0, 0, r.choice([1, 1, -1])) for _ in range(40)]
    held = [(t, min(n, len(t) - 4), a, b, lo) for t, n, a, b, lo in held]
    seen = Counter()
    for t, n, _, _, lo in held:
        for s in range(n):
            seen[t[s : s + 5]] += 1 if lo >= 0 else 2
    assert [x.tolist() for x in suffixes._repeated(held, 5)] == [[s for s in range(n) if seen[t[s : s + 5]] > 1] for t, n, *_ in held]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from terrace.llm import repeats

    monkeypatch.setattr(repeats, "HOT_ROWS", 3)
    texts = drawn(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in dedup_bytes(df, length=60, core=20).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes([t.encode() for t in texts], 60)
    assert Counter(tuple(r)[1:] for r in phrases.dedup_phrases(df, length=10, core=4).collect()) == brute_words([(i, t.encode()) for i, t in enumerate(texts)], 10)


def test_edges_of_bytes(edges, nothing):
    got = Counter(tuple(r)[1:] for r in dedup_bytes(edges).collect())
    assert got == Counter(brute_bytes([(r[1] or "").encode() for r in edge_rows()], 200))
    assert dedup_bytes(nothing).count() == 0


def test_edges_of_words(edges, nothing):
    # Rows of one id are in order of their text's hash, which brute force doesn't know: here their texts share no window.
    rows = [(r[0] if r[0] is not None else -(2**63), (r[1] or "").encode()) for r in edge_rows()]
    got = Counter(tuple(r)[1:] for r in phrases.dedup_phrases(edges).collect())
    assert got == brute_words(rows, 20)
    assert phrases.dedup_phrases(nothing).count() == 0


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = low(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """rows: (id, text) with an id. Least id of each id's component, and each row's set size."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), find(i), find(i) == i) for i, s in sets)


def near_rows(seed, n=12, copies=14):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = prose(seed * 50 + k, r.choice([3, 5, 8, 30, 90])).split()
        for _ in range(r.randint(1, copies)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = "zz%d" % r.randrange(9)
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_exact(spark, seed):
    rows = near_rows(seed)
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_near_duplicates_in_crowded_buckets(spark, monkeypatch):
    from terrace.llm import minhash

    monkeypatch.setattr(minhash, "FEW", 3)
    base = prose(77, 60)
    rows = [(i, base + " " + prose(500 + i, 30)) for i in range(40)] + [(100 + i, base + " " + prose(500 + i, 30) + " end") for i in range(40)]
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_short_near_duplicates_among_many_long_holders_of_their_passage(spark, monkeypatch):
    from pyspark.sql import functions as F
    from terrace.llm import minhash

    monkeypatch.setattr(minhash, "FEW", 3)
    # Ids that no hash order of a bucket names first.
    late = [F.xxhash64("id", F.lit(i)) > 2**62 for i in (1, 2)]
    ids = [r.id for r in spark.range(2000, 3000).where(late[0] & late[1]).orderBy("id").limit(5).collect()]
    base = prose(78, 120)
    short = [(i, base + " " + prose(9000 + i, 5)) for i in ids]
    rows = [(i, base + " " + prose(4000 + i, 48)) for i in range(300)] + short
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert brute_components(short) == Counter((i, 121, ids[0], i == ids[0]) for i in ids)
    assert got == {i: min(i, ids[0]) for i, _ in rows}


def test_prefixes_name_every_near_pair(spark, tmp_path):
    from terrace.llm import minhash

    rows = near_rows(3)
    texts = spark.createDataFrame([(i, 0, i, t) for i, t in rows], "id long, th long, component long, text string")
    got = {tuple(sorted((r.a, r.b))) for r in minhash.prefix_pairs(texts, str(tmp_path)).collect()}
    sets = {i: set(shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()) for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert near <= got and len(near) > 50


def test_edges_of_near_duplicates(edges, nothing, spark):
    named = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    got = near_duplicates(edges).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == brute_components(named)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None) and len(got) == len(edge_rows())
    assert near_duplicates(nothing).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(base[:350]), np.unique(base[50:])
    sa, sb = signatures([a, b])
    assert abs((sa == sb).mean() - 300 / 400) < 0.12
    tiny = signatures([np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert len(set(tiny[0].tolist())) == 1
    assert [len(s) for s in shingle_sets(np.frombuffer(b"a b c d e f  a b", np.uint8), np.array([0, 12, 16]))] == [2, 1]

