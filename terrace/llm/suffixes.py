"""Suffix-array dedup of bytes: what any 200-byte string covers that starts anywhere else too is removed.

Which suffixes can matter is found by counting (see repeats): only those that start at the core of a context which
shares its core with another one are sorted. Each task sorts the suffixes of its documents into runs, one for each shard
of cores, and front-codes them: every suffix is stored as the length of the prefix it shares with the one before and the
rest. Shards exchange these runs and merge them with a loser tree that knows each suffix's common prefix with the last
winner: two suffixes with different known prefixes are ordered without reading a byte, and equal ones are compared from
the known length on. Neighbours in the merged order then show how far to the right any other suffix agrees, which bounds
the windows of a context that can repeat; these are compared byte by byte.

Texts are whole UTF-8 bytes, null as empty; matches never cross documents. Rows that repeat are documents of their own,
so their windows repeat. Other columns are ignored. A row with a null doc_id takes part like any other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, shared_folder, stored
from .repeats import MOST, Found, Shape, cover, crowded_windows, find, join_apart, keyed, removed, runs_of, with_texts

LENGTH, CORE = 200, 64
#: Suffixes a shard has, about; and those a task sorts at a time.
SHARD, RUN = 5_000, 20_000
#: Groups of more suffixes than this compare their windows by 128-bit hashes in arrays, smaller ones byte by byte.
BYTEWISE = 200


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes needn't be compared."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


_ENTRY = struct.Struct("<HHIqqqqi")


def write_run(entries: list[tuple[bytes, tuple]]) -> bytes:
    """A front-coded run. entries: (suffix, (left, core, context, id, th, lo)), sorted by suffix."""
    out, before = [], b""
    for suffix, (left, *numbers) in entries:
        n = common(before, suffix)
        out.append(_ENTRY.pack(n, len(suffix) - n, len(left), *numbers))
        out.append(suffix[n:])
        out.append(left)
        before = suffix
    return b"".join(out)


def read_run(data: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the one before, suffix, payload) of each entry."""
    at, before = 0, b""
    while at < len(data):
        n, rest, width, *numbers = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        suffix = before[:n] + data[at : at + rest]
        at += rest
        yield n, suffix, (data[at : at + width], *numbers)
        at += width
        before = suffix


def merge_runs(runs: Iterable[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs; each item comes with its common prefix with the item before it.

    The tree's nodes keep losers with their common prefix with the winner that beat them. As long as that winner is what
    came out last, a longer known prefix means a smaller suffix, and only equal known prefixes need bytes, from there on.
    """
    sources = list(runs)
    k = 1
    while k < max(1, len(sources)):
        k *= 2
    heads: list = [next(s, None) for s in sources] + [None] * (k - len(sources))
    known = [0] * k  # common prefix of each source's head with the last winner

    def beats(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known prefix, now with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x[1], y[1], known[a])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = beats(build(2 * node), build(2 * node + 1))
        return won

    best = build(1) if k > 1 else 0
    while heads[best] is not None:
        yield known[best], heads[best][1], heads[best][2]
        heads[best] = next(sources[best], None) if best < len(sources) else None
        known[best] = heads[best][0] if heads[best] is not None else 0  # with the one before in its run, which came out last
        node, won = (best + k) // 2, best
        while node >= 1:
            won, losers[node] = beats(won, losers[node])
            node //= 2
        best = won


def sorted_runs(texts: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """shard, run: front-coded sorted runs of the suffixes that start at the units' cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            names = sorted(held)
            runs = [write_run(sorted(held[s], key=lambda e: e[0])) for s in names]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(runs, pa.binary())], names=["shard", "run"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, th, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), (batch.column(2)[i].as_py() or "").encode()
                anchors = shape.anchors(shape.cores(np.frombuffer(raw, np.uint8)))
                for u in batch.column(3)[i].as_py():
                    lo, hi = u["lo"], u["hi"]
                    anchor = int(anchors[lo])
                    many = -1 if u["many"] > 1 else hi  # windows of a context that occurs again are settled
                    entry = raw[anchor : hi + shape.length], (raw[lo:anchor], u["core"], u["context"], name, th, lo if many == hi else -1 - lo)
                    held.setdefault(u["core"] % shards, []).append(entry)
                    count += 1
                if count >= RUN:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "shard int, run binary")


def settle(group: list[tuple[int, bytes, tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, th, lo, hi) of repeated windows in a group of suffixes that share their core, in sorted order.

    Each item: (common prefix with the one before, suffix, payload); a context counts once.
    """
    if len({x[2][2] for x in group}) < 2:
        return
    n = len(group)
    right = [max(group[i][0] if i else 0, group[i + 1][0] if i + 1 < n else 0) for i in range(n)]
    held, done = [], set()
    for (_, suffix, (left, _, context, name, th, lo)), agree in zip(group, right):
        # A window that starts at s has `length - (a - s)` bytes from the core on, which another suffix must share.
        last = min(len(left) + len(suffix) - length, agree + len(left) - length)
        if context not in done and last >= 0:
            held.append((left + suffix, last + 1, name, th, lo))
        done.add(context)
    for (_, _, name, th, lo), again in zip(held, _repeated(held, length)):
        if lo >= 0:
            for a, b in runs_of(again):
                yield name, th, lo + a, lo + b


def _repeated(held: list[tuple], length: int) -> Iterator[np.ndarray]:
    """For each (text, windows, .., .., lo): places of windows that occur again in the texts. lo < 0: the text itself does."""
    if len(held) <= BYTEWISE:
        seen: dict[bytes, int] = {}
        for text, n, *_, lo in held:
            for s in range(n):
                w = text[s : s + length]
                seen[w] = seen.get(w, 0) + (1 if lo >= 0 else 2)
        for text, n, *_ in held:
            yield np.array([s for s in range(n) if seen[text[s : s + length]] > 1], np.int64)
        return
    data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
    n = np.array([x[1] for x in held])
    begin = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(begin, n)
    one, two = (Rolling(data, seed).between(at, at + length) for seed in (1, 2))
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    which = np.cumsum(new) - 1
    weight = np.repeat(np.array([1 if x[4] >= 0 else 2 for x in held]), n)
    again = np.empty(len(order), bool)
    again[order] = (np.bincount(which, weight[order]) > 1)[which]
    for a, k in zip(first.tolist(), n.tolist()):
        yield np.flatnonzero(again[a : a + k])


COVERED = "id long, th long, lo int, hi int"


def merged_shards(runs: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """Repeated windows, from each shard's runs. A shard holds about SHARD suffixes; none of its cores has over MOST contexts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in batches for x in b.column(1).to_pylist()]
        out: list[tuple] = []
        group: list = []
        for item in merge_runs([read_run(x) for x in held]):
            if group and (item[0] < shape.core or item[2][1] != group[0][2][1]):
                out += settle(group, shape.length)
                group = []
            group.append(item)
        out += settle(group, shape.length)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "th", "lo", "hi"])

    return runs.groupBy("shard").applyInArrow(run, COVERED)


def repeated_windows(rows: DataFrame, shape: Shape, folder: str, most: int = MOST) -> DataFrame:
    """id, th, lo, hi: stretches of windows that start anywhere else too."""
    found: Found = find(rows, shape, folder)
    again = found.contexts.where("many > 1").select("core", "context", "many")
    settled = join_apart(found.candidates, again, ["core", "context"], "many", found.total).select("id", "th", "lo", "hi")
    usual, crowded = found.branching.where(F.col("n") <= most), found.branching.where(F.col("n") > most)
    shards = max(1, -(-usual.count() // SHARD))
    merged = merged_shards(stored(sorted_runs(with_texts(usual, rows), shape, shards), f"{folder}/runs"), shape, shards)
    covered = settled.union(merged)
    if not crowded.isEmpty():
        covered = covered.union(crowded_windows(crowded, rows, shape, folder))
    return stored(covered, f"{folder}/covered")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_bytes(docs: DataFrame, length: int = LENGTH, core: int = CORE, folder: str | None = None, most: int = MOST) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    folder = folder or shared_folder(docs.sparkSession)
    rows, shape = keyed(docs), Shape(length, core, words=False)

    def finish(raw: bytes, stretches: list[dict]) -> tuple:
        if not stretches:
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
        gone = cover(len(raw), stretches, length)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        begin = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), len(raw) - len(kept), begin, hashlib.sha256(kept).hexdigest()

    return removed(rows, repeated_windows(rows, shape, folder, most), finish, RESULT, [x.split()[0] for x in RESULT.split(", ")])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op6_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS s FROM docs WHERE octet_length(b) >= 200),
windows AS (SELECT doc_id, s, array_slice(b, s, s + 199) AS x FROM places),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY x) AS n FROM windows) WHERE n > 1),
cut AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM again),
islands AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM cut),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 199 AS z FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT g.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(CASE WHEN a > before + 1 THEN hex(array_slice(d.b, before + 1, a - 1)) ELSE '' END, '' ORDER BY a) AS rest
  FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN k.doc_id IS NULL THEN sha256(d.b)
       ELSE sha256(unhex(k.rest || CASE WHEN k.last < octet_length(d.b) THEN hex(array_slice(d.b, k.last + 1, octet_length(d.b))) ELSE '' END)) END AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
}
