import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrace.llm.attribution import attribute, count_tokens
from terrace.llm.packing import pack, pack_histogram, slots
from terrace.llm.tokenbin import Segment, read_token_files, write_segment, write_token_files
from terrace.llm.tokens import Encoder, tokenizer_path

from .conftest import edge_rows


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_encode_as_the_whole_text():
    own, other, r = Encoder(tokenizer_path()), library(), random.Random(1)
    fixed = ["a  b", "\n", "a\n\nb", "x 's", "don't 's ok", "<|endoftext|> a", "hello <|endoftext|> world", "a<|endoftext|>b\n<|endoftext|>", "<|endoftext |>", " lead", "trail ", "a\tb", "1 2,3 .\n. x", "日本 語\nx", "a\r\nb", "a\0b c", "", "x \x1c y", "a᠎b c", "word, word. word.,"]
    drawn = ["".join(r.choice("ab 's.,\n\t1é日\0　") for _ in range(r.randint(0, 16))) for _ in range(1500)]
    for text in fixed + drawn:
        assert own.encode([text])[0] == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_letters_go_to_the_model_directly():
    own, other, r = Encoder(tokenizer_path()), library(), random.Random(2)
    letters = [x for x in map(chr, range(0x300)) if x.isalpha()] + list("жшλ日ﬁǅ")
    assert own.direct
    for _ in range(400):
        words = ["".join(r.choices(letters, k=r.randint(1, 12))) + r.choice(["", "", ".", ",", "x"]) for _ in range(12)]
        text = "".join(r.choice([" ", " ", "\n"]) + x for x in words)[r.randint(0, 1) :]
        assert own.encode([text])[0] == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_table_is_bounded(monkeypatch):
    from terrace.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_BYTES", 500)
    own, other = Encoder(tokenizer_path()), library()
    for text in ("some words here and there", "other words, there and here.", "some words here and there\nagain and again"):
        assert own.encode([text])[0] == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_histogram_packing(seed):
    r = random.Random(seed)
    counts = Counter(min(64, int(r.expovariate(1 / 20)) + 1) for _ in range(r.choice([0, 1, 50, 3000])))
    found = pack_histogram(counts, 64)
    held = Counter()
    for p in found:
        assert sum(p.lengths) <= 64
        for n in p.lengths:
            held[n] += p.count
    assert held == counts
    # Each rank of each length has one slot.
    taken = defaultdict(list)
    for p in found:
        for n, first in zip(p.lengths, p.ranks):
            taken[n] += range(first, first + p.count)
    assert all(sorted(x) == list(range(counts[n])) for n, x in taken.items())
    assert len(slots(found)["length"]) == sum(len(p.lengths) for p in found)
    if sum(counts.values()) > 1000:
        assert sum(k * n for n, k in counts.items()) > 0.97 * 64 * sum(p.count for p in found)
    with pytest.raises(ValueError):
        pack_histogram({65: 1}, 64)


def test_packing_holds_every_id_once(edges):
    expected = Counter()
    for row in edge_rows():
        ids = ids_of(row[1], 1)
        for a in range(0, len(ids), 2048):
            expected[row[0], a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    got = pack(edges).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))


def test_packing_of_nothing(nothing):
    assert pack(nothing).count() == 0


def test_segments_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 4096, 4097, 20_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
        data = write_segment(ids, [3, None], np.array([n // 2, n - n // 2]), lanes=16, block=4096)
        seg = Segment(data)
        assert (seg.decode() == ids).all() and seg.names == [3, None] and seg.lengths.sum() == n
        for b in range(seg.blocks):  # any block alone
            assert (seg.decode(range(b, b + 1)) == ids[b * 4096 : (b + 1) * 4096]).all()
    with pytest.raises(ValueError):
        Segment(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])
    skewed = np.concatenate([np.zeros(50_000, np.uint32), np.arange(5000, dtype=np.uint32)])
    assert (Segment(write_segment(skewed, [1], np.array([55_000]))).decode() == skewed).all()


def test_token_files(spark, edges, nothing, tmp_path):
    got = read_token_files(write_token_files(edges, str(tmp_path / "a"), segment=500)).collect()
    expected = Counter((r[0], len(ids_of(r[1], 2)), zlib.crc32(ids_of(r[1], 2).tobytes())) for r in edge_rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    for r in ordered:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2
        at += r.n_tokens
    assert read_token_files(write_token_files(nothing, str(tmp_path / "b")), with_ids=False).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority", "fraction"])
def test_attribution_against_characters(rule):
    r = random.Random(3)
    for _ in range(200):
        cuts = sorted(r.sample(range(0, 60), r.randint(0, 8)))
        parts = list(zip(cuts[::2], cuts[1::2]))
        spans, at = [], 0
        while at < 60:
            n = r.randint(1, 9)
            spans.append((at, min(60, at + n)))
            at += n
        owner = [next((i for i, (a, b) in enumerate(parts) if a <= c < b), len(parts)) for c in range(60)]
        expected = np.zeros(len(parts) + 1)
        for a, b in spans:
            own = owner[a:b]
            if rule == "start":
                expected[own[0]] += 1
            elif rule == "majority":
                most = max(Counter(own).values())
                expected[next(o for o in own if Counter(own)[o] == most)] += 1
            else:
                for o in own:
                    expected[o] += 1 / len(own)
        got, _ = attribute(np.array(spans), np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64), rule)
        assert np.allclose(got, expected)


def test_token_counts(spark, edges, nothing):
    got = count_tokens(edges).collect()
    t = library()
    expected = Counter()
    for row in edge_rows():
        if row[1]:
            code = t.encode(row[1], add_special_tokens=False)
            starts = [0] + [i + 1 for i, c in enumerate(row[1]) if c == "\n" and i + 1 < len(row[1])]
            for k, a in enumerate(starts):
                b = starts[k + 1] if k + 1 < len(starts) else len(row[1])
                expected[row[0], k, b - a, sum(a <= s < b for s, _ in code.offsets), len(code.ids)] += 1
    assert Counter((r.doc_id, r.section, r.n_chars, int(r.n_tokens), r.doc_tokens) for r in got) == expected
    given = spark.createDataFrame([(1, "title body", [("t", 0, 5), ("b", 6, 10)]), (2, "x", None), (3, None, [("t", 0, 1)])], "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>")
    rows = count_tokens(given, "parts", "fraction").collect()
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == pytest.approx(len(t.encode("title body").ids))
    assert {r.doc_id for r in rows} == {1, 2}
    backwards = spark.createDataFrame([(1, "title body", [("b", 6, 10), ("t", 0, 5)])], given.schema)
    assert [(r.name, r.n_tokens) for r in count_tokens(backwards, "parts").collect()] == [(r.name, r.n_tokens) for r in count_tokens(given, "parts").where("doc_id = 1").collect()]
    for wrong in ([("a", 0, 5), ("b", 4, 9)], [("a", 5, 2)]):
        with pytest.raises(Exception, match="overlap"):
            count_tokens(spark.createDataFrame([(1, "title body", wrong)], given.schema), "parts").collect()
    assert count_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        count_tokens(edges, rule="none")
