import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import decontaminate, langid, quality
from terrace.llm.decontaminate import MultiIndex, contaminated, distance
from terrace.llm.graph import components
from terrace.llm.linededup import dedup_lines

from .conftest import edge_rows, prose
from .test_repeats import low

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OTHER = "sch ung der ein ich zu auf ver ge be lich keit tz ß ü ä und die das".split()


def tongues(n=160):
    return [(i, prose(i, 40, OTHER) if i % 3 == 0 else prose(i, 40), "de" if i % 3 == 0 else "en") for i in range(n)]


def test_languages_of_held_out_documents(spark):
    df = spark.createDataFrame(tongues(), "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    import zlib

    for i, _, lang in tongues():
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i].lang_pred == lang and 0 <= rows[i].score <= 1
    # Labels of held-out rows are never learned: with others there, nothing changes.
    wrong = df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r for r in langid.identify(wrong).collect()} == rows


def test_kernel_and_ridge_against_dictionaries():
    """The kernel by sets of n-grams, and the ridge regression over explicit features of the landmarks' space."""
    rows = tongues(60)
    texts, labels = [r[1] for r in rows] + ["Aa", "é ß", "x"], [r[2] for r in rows] + ["en", "de", "en"]
    model = langid.fit(texts, labels, landmarks=6)

    def spectrum(t):
        b = t.encode().translate(bytes(langid.LOWER))
        return {b[i : i + n] for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)}

    sets = [spectrum(t) for t in texts]
    marks = [i for k in ("de", "en") for i in [j for j, x in enumerate(labels) if x == k][:6]]
    marks = sorted(marks)
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    expected = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    got = model.kernel(*langid._joined(texts))
    assert np.allclose(got, expected, atol=1e-5)
    among = expected[marks]
    factor = np.linalg.inv(np.linalg.cholesky(among + 1e-6 * np.eye(len(marks)))).T  # any square root of the inverse serves
    z = expected @ factor
    w = np.sqrt([len(labels) / 2 / labels.count(x) for x in labels])[:, None]
    y = np.array([[1.0 if x == k else -1.0 for k in ("de", "en")] for x in labels])
    solved = np.linalg.lstsq(np.concatenate([z * w, math.sqrt(langid.RIDGE) * np.eye(len(marks))]), np.concatenate([y * w, np.zeros((len(marks), 2))]), rcond=None)[0]
    assert np.allclose(model.scores(*langid._joined(texts)), z @ solved, atol=2e-3)


def test_language_edges(spark, edges, nothing):
    rows = langid.identify(edges).collect()
    assert len(rows) == len(edge_rows())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(r.lang_pred == "und" and r.score == 0 for i in (1, 2, 3, 13) for r in by[i]) and by[11][0].lang_pred in ("a", "b")
    assert not any(r.held_out for r in by[None])
    assert langid.identify(nothing).count() == 0
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(edges, least=0.0)
    assert kept.columns == edges.columns and kept.where("doc_id in (1, 2, 3, 13)").count() == 0


def counts_of(text):
    w = WORD.findall(text or "")
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        dup += x in seen and bool(WORD.search(x))
        seen.add(x)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed


def test_base_rules(edges, nothing):
    got = quality.quality(edges).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *counts_of(r[1])) for r in edge_rows())
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(nothing).count() == 0
    for text in ("a\na\n\n\nb #|\na", "x y z x y z", "é # é", "\x1c \x85 a"):
        assert quality.text_counts(text.encode(), text) == counts_of(text)[:5]


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over bytes, order 4, by dictionaries."""
    grams = Counter()
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            grams[b[i - 3 : i + 1]] += 1
    orders = {4: grams}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    p = {}
    for k in (1, 2, 3, 4):
        t = [sum(c == i for c in orders[k].values()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else None
        d = [max(0.0, i - (i + 1) * y * t[i] / t[i - 1]) if y is not None and t[i - 1] else 0.5 for i in (1, 2, 3)]
        total, spared = Counter(), Counter()
        for g, c in orders[k].items():
            total[g[:-1]] += c
            spared[g[:-1]] += d[min(c, 3) - 1]
        for g, c in orders[k].items():
            under = p[g[1:]] if k > 1 else 1 / 256
            p[g] = max(0.0, c - d[min(c, 3) - 1]) / total[g[:-1]] + spared[g[:-1]] / total[g[:-1]] * under
    return p


def brute_log_p(p, texts, text):
    """Of a text under the model by dictionaries, which backs off where an n-gram wasn't counted."""
    grams = Counter()
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            grams[b[i - 3 : i + 1]] += 1
    orders = {4: grams}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    spared = {}
    for k in (1, 2, 3, 4):
        by = defaultdict(list)
        for g, c in orders[k].items():
            by[g[:-1]].append((g, c))
        for h, held in by.items():  # what the counted leave, spread over all bytes by the shorter model
            under = lambda g: p[g[1:]] if k > 1 else 1 / 256  # noqa: B023, E731
            g, c = held[0]
            t = [sum(x == i for x in orders[k].values()) for i in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else None
            d = [max(0.0, i - (i + 1) * y * t[i] / t[i - 1]) if y is not None and t[i - 1] else 0.5 for i in (1, 2, 3)]
            spared[h] = sum(d[min(x, 3) - 1] for _, x in held) / sum(x for _, x in held)
    total, b = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(b)):
        g, w = b[i - 3 : i + 1], 1.0
        while g and g not in p:
            w *= spared.get(g[:-1], 1.0)
            g = g[1:]
        total += math.log(w * (p[g] if g else 1 / 256))
    return total


@pytest.mark.parametrize("most", [10**6, 700])
def test_hash_arrays_back_off(spark, most, tmp_path):
    """Texts with n-grams that were never counted, by one array and by shards."""
    texts, fresh = [prose(i, 30) for i in range(40)], [prose(99, 30), "ÄÖ zq zq! \x01~", "the the 77 the"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(100, "wort " * 9, "de")], "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.ngram_counts(df), str(tmp_path / "m"))
    shards = list(quality.hash_arrays(model, most))
    assert len(shards) == (1 if most > 700 else shards[0].shards) and (most > 700 or len(shards) > 2)
    p = brute_kneser_ney(texts)
    new = spark.createDataFrame([(i, t, "en") for i, t in enumerate(fresh)], df.schema)
    got = {r.doc_id: r.log_perplexity for r in quality._scored_by_all(new, iter(shards), str(tmp_path / "s")).collect()}
    for i, t in enumerate(fresh):
        assert math.isclose(-got[i] * len(t.encode()), brute_log_p(p, texts, t), rel_tol=1e-5)


def test_model_and_bands(spark, tmp_path):
    texts = [prose(i, 80) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(900, "|".join(prose(9, 90).split()[::-1]).replace("|", " | x~"), "en")], "doc_id long, text string, lang string")
    grams = quality.ngram_counts(df.where("doc_id < 900"))
    model = {r.gram.to_bytes(r.order, "big"): r.p for r in quality.kneser_ney(grams, str(tmp_path)).where("p IS NOT NULL").collect()}
    expected = brute_kneser_ney(texts)
    assert model.keys() == expected.keys() and all(math.isclose(model[g], expected[g], rel_tol=1e-9) for g in expected)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert not got[900].kept and not got[900].lower <= got[900].log_perplexity <= got[900].upper
    assert all(got[i].kept == (not got[i].base_failed) for i in range(60))


def test_bands_reject_table_junk_near_the_clean_texts(spark):
    junk = [(1000 + e, " ".join(x + " |" * (k % e == 0) for k, x in enumerate(prose(5000 + e, 80).split())), "en") for e in (2, 3, 4, 5, 6, 8, 10, 14, 20)]
    df = spark.createDataFrame([(i, prose(i, 80), "en") for i in range(200)] + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality(df).where("kept").select("doc_id").collect()}
    assert kept >= set(range(200)) and 1002 not in kept


def brute_lines(rows, sites, copies=None):
    has = lambda x: bool(WORD.search(x))
    spread, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            spread[x].add(s)
            texts[x].add(t)
    out = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        n = sum(map(has, lines))
        bad = [x for x in lines if has(x) and len(spread[x]) >= sites and len(texts[x]) >= sites]
        if bad and not (copies is not None and (len(bad) == n or len(bad) > copies and 2 * len(bad) > n)):
            out[i, "\n".join(x for x in lines if x not in bad), n, len(bad)] += 1
        else:
            out[i, t, n, 0] += 1
    return out


@pytest.mark.parametrize("sites", [3, 12])
@pytest.mark.parametrize("copies", [None, 2])
def test_line_spread(spark, sites, copies):
    r = random.Random(sites)
    stock = [f"stock line {k}" for k in range(12)]
    rows = []
    for i in range(150):
        own = [f"own {i} {j}" for j in range(r.randint(0, 5))] + r.sample(stock[: 1 + i % 12], r.randint(0, min(6, 1 + i % 12))) + ["", " "][: r.randint(0, 2)]
        r.shuffle(own)
        rows.append((i, "\n".join(own), f"s{r.randint(0, sites + 2)}"))
    rows += [(500 + i, rows[0][1], f"t{i}") for i in range(20)] + [(600, None, "x"), (601, "", None), (602, stock[0], None), (602, stock[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, sites, copies).collect())
    assert got == brute_lines(rows, sites, copies)


def test_a_hot_site_that_sorts_first_hides_no_spread(spark):
    rows = [(i, f"page {i // 2}\ncommon footer", "a" if i % 2 else f"s{i % 20}") for i in range(200)]  # site a mirrors every page
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.n_removed for r in got} == {1} and {r.text for r in got} == {f"page {i}" for i in range(100)}


def test_line_edges(edges, nothing):
    got = dedup_lines(edges, 2)
    assert got.columns == [*edges.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute_lines([(r[0], r[1], r[3]) for r in edge_rows()], 2)
    assert dedup_lines(nothing).count() == 0


CLASHES = ["_id", "_doc", "_whole", "_n", "_gone", "score", "lang_pred", "_predicted", "n_lines", "n_removed", "line", "at", "th", "bucket", "a", "b", "Text_", "held_out"]


def test_names_that_clash(spark, edges):
    """Columns with the names that operators and stages use inside come back unchanged."""
    import corpus_pipeline
    from terrace.llm import attribution, minhash, packing, phrases, suffixes, tokenbin

    marked = edges.drop(*CLASHES).select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    same = lambda df: sorted((tuple(r[c] for c in ["doc_id", *CLASHES]) for r in df.collect()), key=repr)
    every = same(marked)
    assert same(dedup_lines(marked, 2, report=("x_lines", "x_removed"))) == every
    kept = langid.keep_identified(marked, least=0.0)
    assert kept.columns == marked.columns and set(same(kept)) <= set(every)
    assert corpus_pipeline.dedup_lines(spark, marked, "").columns == marked.columns and same(corpus_pipeline.dedup_lines(spark, marked, "")) == every
    assert set(same(minhash.keep_one(marked))) <= set(every) and minhash.keep_one(marked).columns == marked.columns
    bench = spark.createDataFrame([(1, prose(3, 40), "x")], "item_id long, text string, _gone string")
    assert len(same(decontaminate.decontaminate(marked, bench))) == len(every) - 2
    n = len(every)
    assert langid.identify(marked).count() == quality.quality(marked).count() == suffixes.dedup_bytes(marked).count() == phrases.dedup_phrases(marked).count() == n
    assert packing.pack(marked).where("start = 0").count() == n and attribution.count_tokens(marked).count() > 0
    assert tokenbin.read_token_files(tokenbin.write_token_files(marked, f"{spark.conf.get('spark.checkpoint.dir')}/clash"), with_ids=False).count() == n


def test_multi_index_finds_every_fingerprint():
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**63, 40, dtype=np.uint64)
    queries = np.concatenate([prints ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (0, 5, 12, 19, 22, 23, 24, 30)])
    q, p = MultiIndex(prints).search(queries)
    every = {(i, j) for i in range(len(queries)) for j in range(40) if distance(queries[i : i + 1], prints[j : j + 1])[0] <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), p.tolist())) == every and len(q) == len(every)


def brute_matches(docs, items, least=0.75):
    def sh(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    kept = [(i, WORD.findall(low(t))) for i, t in items]
    kept = [(i, w, Counter(sh(w))) for i, w in kept if w]
    df = Counter(x for _, _, c in kept for x in c)
    weight = lambda x: 1 + math.log(len(kept) / df[x]) if x in df else 1 + math.log(len(kept))
    out = set()
    for d, t in docs:
        w = WORD.findall(low(t or ""))
        for i, iw, c in kept:
            for a in range(len(w) - len(iw) + 1):
                own = Counter(sh(w[a : a + len(iw)]))
                both = set(own) | set(c)
                if sum(weight(x) * min(own[x], c[x]) for x in both) / sum(weight(x) * max(own[x], c[x]) for x in both) >= least:
                    out.add((d, i))
                    break
    return out


def test_contamination(spark):
    r = random.Random(5)
    items = [(k, prose(700 + k, r.choice([1, 3, 6, 25, 40]))) for k in range(25)] + [(90, None), (91, " "), (92, prose(700, 30))]
    docs = []
    for i in range(60):
        w = prose(i, r.randint(0, 60)).split()
        if i % 2:
            hit = r.choice(items[:25])[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                hit[r.randrange(len(hit))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if r.random() < 0.2 else x for x in hit]
        docs.append((i, " ".join(w)))
    docs += [(70, None), (71, ""), (72, docs[1][1]), (72, docs[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(d, b).collect()
    expected = brute_matches(docs, [(i, t) for i, t in items if t])
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected) and len(expected) > 20


def test_recall_of_fingerprints(spark):
    d = "/root/testdata/sf0.01"
    found, there = decontaminate.recall(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert found == there > 20


def test_contamination_edges(spark, edges, nothing, monkeypatch):
    bench = spark.createDataFrame([(1, prose(3, 40)), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in contaminated(edges, bench).collect()} == {8, 9}
    assert decontaminate.decontaminate(edges, bench).count() == len(edge_rows()) - 2
    assert contaminated(nothing, bench).count() == 0 and contaminated(edges, bench.where("false")).count() == 0
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 100)  # several groups of items
    assert {r.doc_id for r in contaminated(edges, bench.union(spark.createDataFrame([(3, prose(1, 30)), (4, prose(2, 30))], bench.schema))).collect()} == {5, 6, 7, 8, 9, -7}


def test_components(spark, tmp_path):
    r = random.Random(9)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), str(tmp_path / "c")).collect()}
    least = {n: n for p in pairs for n in p}
    for _ in range(80):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: c for n, c in least.items() if n != 5 or any(5 in p and p != (5, 5) for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 80) + "\nAll rights reserved here.", "en", f"s{i % 12}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(5)]
    rows += [(200, "1234 5678", None, "s2", 1), (201, None, None, None, None), (202, prose(7000, 20) + " " + prose(900, 30), "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] == {r[0] for r in rows} - {200, 201} and ids[1] == ids[0]
    assert seen[1].where(F.col("text").contains("rights reserved here.") & ~F.col("text").contains("tail")).count() == 0
    assert ids[2] == ids[1] - {100, 101, 102, 103, 104} and ids[3] == ids[2] - {202} and ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def brute_pipeline(spark, rows, items):
    """The kept rows (id, text) after four stages. The first stage's verdict is its operator's, which is tested on its own."""
    import corpus_pipeline
    from .test_repeats import brute_components

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    langs = {(r.doc_id, r.text) for r in langid.keep_identified(df, least=corpus_pipeline.LEAST_SCORE).collect()}
    rows = [r for r in rows if (r[0], r[1]) in langs]
    cut = brute_lines([(r[0], r[1], r[3]) for r in rows], 8, corpus_pipeline.BLOCK_LINES)
    docs = [(i, t) for (i, t, _, _), n in cut.items() for _ in range(n)]
    least = {i: c for (i, _, c, _), _ in brute_components([d for d in docs if d[0] is not None]).items()}
    docs = [d for d in docs if d[0] is None or least[d[0]] == d[0]]
    gone = {i for i, _ in brute_matches(docs, [x for x in items if x[1]])} - {None}
    return [d for d in docs if d[0] not in gone]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from .test_tokens import ids_of

    rows = [(r[0], r[1], r[2], r[3], None) for r in edge_rows() if r[0] != 12]
    rows += [(100 + i, prose(i, 70) + "\nAll rights reserved here.\n" + prose(i + 300, 9), "de" if i % 3 else "en", f"s{i % 12}", 7) for i in range(40)]
    rows += [(200 + i, "\n".join(prose(800 + j, 30) for j in range(8) if j != i % 9) + f"\nown {prose(i, 3)}", "en", f"s{i % 12}", 7) for i in range(30)]  # near copies on many sites
    items = [(1, prose(3, 40)), (2, None), (3, ""), (4, prose(5, 60).split()[0] + " " + prose(105, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = brute_pipeline(spark, rows, items)
    got = Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").collect())
    assert got == Counter((i, len(ids_of(t, 1))) for i, t in kept) and 40 < len(kept) < 60


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
