"""Whitening, source divergence and sharding along a curve, against plain evaluations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import divergence, packing, sharding, toxicity, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, curve string, word string, row string"
CLASH = ("c", "c", "c", "c")


# --- 11 --------------------------------------------------------------------------

def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def test_whitening_matches_a_plain_evaluation(spark, tmp_path):
    r = np.random.default_rng(3)
    good = (r.normal(size=(300, 12)) * np.linspace(0.4, 0.05, 12)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(good)]
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, rows[7][1])]
    kept = [v for _, v in rows]
    rows += [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [0.1] * 5), (906, [1e30] * 12)]
    df = vectors(spark, [(*x, "a", "b") for x in rows], ", centred string, whitened string")
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op11_embedding_whitening(spark, str(tmp_path)).toPandas()
    x = np.floor(1024 * np.array(kept, np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    assert len(out) == n * 8 and set(out["n"]) == {n} and Counter(out["component"]) == {k: n for k in range(1, 9)}
    d = n * x - s
    deviation = (d * d).sum(1)
    assert sorted(out[out["component"] == 1]["deviation"]) == sorted(deviation)
    c = d / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    one = out[out["vec_id"] == 11].sort_values("component")
    assert np.allclose(one["explained"], (e / e.sum())[:8], rtol=1e-9)
    mine = {k: np.array([g.set_index("component")["whitened"].get(k)]) for k in range(1, 9) for g in [one]}
    for k in range(8):
        want = c @ u[:, k] / math.sqrt(e[k])
        got = out[out["component"] == k + 1]
        sign = 1 if mine[k + 1][0] * want[11] > 0 else -1
        assert np.allclose(sorted(got["whitened"]), sorted(sign * want), atol=1e-9)
    assert out["identity_error"].nunique() == 1 and 0 <= out["identity_error"].iloc[0] < 1e-9


def test_whitening_of_few_and_flat_vectors(spark, tmp_path):
    assert whitening.whiten(vectors(spark, []))[1] is None
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 4))[0].count() == 0
    line = vectors(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(9)])
    rows, by = whitening.whiten(line)
    assert by.components.shape == (3, 1) and abs(by.variances[0] / by.total - 1) < 1e-12 and whitening.identity_error(rows) < 1e-12
    vectors(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op11_embedding_whitening(spark, str(tmp_path)).count() == 0


def test_exact_deviations_beyond_a_long():
    x = np.array([[1 << 34, 5], [-(1 << 34), 7], [3, 11]], np.int64)
    n, sums = 1 << 29, (3 << 29, 23 << 28)
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    got, c = whitening._centred(x, n, sums)
    assert [int(v) for v in got] == want and np.allclose(c, x - np.array(sums) / n)


# --- 12 --------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least=3, top=200):
    docs, cells, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        found = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(found))
        cells[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least]
        total = {s: sum(cells[lang, s][w] for w in kept) for s in sources}
        whole = sum(total.values())
        p = {s: {w: 1 + 10**9 * (cells[lang, s][w] + 1) // (total[s] + len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (sum(cells[lang, s][w] for s in sources) + 1) // (whole + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if cells[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(order[: top if part == "term" else None])}
    return out


def test_divergence_matches_a_plain_evaluation(spark):
    r = random.Random(11)
    stems = ["".join(r.choice("abcdeÄßéK") for _ in range(r.randint(1, 4))) for _ in range(300)] + ["日本", "İx"]
    text = lambda n: " ".join(r.choice(stems) + r.choice(["", ".", "1", "\x00", "_"]) + r.choice(["", "Z"]) for _ in range(n))
    rows = [(text(40), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None, ""])) for _ in range(120)] + [(text(20), "en", "hot")] * 60
    rows += [(None, "en", "silent"), ("", None, None), ("!!! 123", "xx", "m"), ("lone words", "xx", "n"), ("alone", "yy", "only"), (text(20_000), "en", "long")]
    df = spark.createDataFrame([(i % 7 if i % 5 else None, *x[:1], *x[1:], 0, *CLASH) for i, x in enumerate(rows)], DOCS).repartition(6)
    for least, top in ((3, 200), (1, 5)):
        got = divergence.divergence(df, least, top)
        assert {tuple(x) for x in got.collect()} == plain_divergence(rows, least, top)
        assert got.count() == len({tuple(x) for x in got.collect()})
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_over_many_stretches(spark):
    r = random.Random(5)
    names = ["".join(chr(97 + (k // 26**i) % 26) for i in range(4)) for k in range(divergence.STRETCH * 3)]
    rows = [(" ".join(w for w in names if r.random() < 0.6), "en", s) for s in "abcabc"]
    df = spark.createDataFrame([(i, *x, 0, *CLASH) for i, x in enumerate(rows)], DOCS)
    assert {tuple(x) for x in divergence.divergence(df).collect()} == plain_divergence(rows)


def test_shares_are_exact():
    r = random.Random(2)
    whole = np.array([r.randint(1, 1 << 50) for _ in range(2000)], np.int64)
    count = np.array([r.randint(0, int(w) - 1) for w in whole], np.int64)
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (int(c) + 1) // int(w) for c, w in zip(count, whole, strict=True)]


# --- 13 --------------------------------------------------------------------------

@pytest.mark.parametrize(("n", "bits"), [(2, 5), (3, 4), (4, 3), (1, 6), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    grid = np.stack([a.ravel() for a in np.indices([1 << bits] * n)], 1)
    at = sharding.hilbert_index(grid, bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def odd_rows(n=500):
    r = random.Random(9)
    rows = [(i, "x" * r.randint(0, 300), r.choice(["en", "de", "fr"]), f"src{r.randint(0, 9)}") for i in range(n)]
    rows += [(None, None, None, None), (3, "same", "en", "hot"), (3, "same", "en", "hot"), (4, "é" * 50_000, "en", "hot"), (5, "", "en", "")] + [(1000 + i, "copy of one text", "en", "hot") for i in range(n // 2)]
    return rows


def test_shards_hold_their_law(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([(*x, 0, *CLASH) for x in rows], DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op13_hilbert_shards(spark, str(tmp_path)).toPandas()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(zip(out["doc_id"].fillna(-1).astype(int), out["size"], out["text_crc32"], strict=True)) == want
    n = out["shard"].value_counts()
    assert set(n.index) == set(range(16)) and n.max() - n.min() <= 1 and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    ordered = out.sort_values(["shard", "slot"])["curve"]
    assert ordered.is_monotonic_increasing
    none = spark.createDataFrame([], DOCS)
    assert sharding.shards(none).count() == 0
    few = sharding.shards(none.sparkSession.createDataFrame([(i, "t", "en", "s", 0, *CLASH) for i in range(3)], DOCS)).toPandas()
    assert few["shard"].nunique() == 3 and (few["slot"] == 0).all()


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    rows = odd_rows(4000)
    df = spark.createDataFrame([(*x, 0, *CLASH) for x in rows], DOCS)
    manifest = sharding.write_shards(df, str(tmp_path / "out"), 64)
    back = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert back.count() == len(rows) and set(df.columns) <= set(back.columns) and manifest.agg(F.sum("rows")).first()[0] == len(rows)
    of = lambda c: Counter(r["shard"] for r in back.filter(c).select("shard").collect())
    for ask, where in (({"source": ("src3", "src3")}, "source = 'src3'"), ({"doc_id": (100, 200)}, "doc_id BETWEEN 100 AND 200"), ({"size": (None, 20)}, "coalesce(octet_length(text), 0) + 1 <= 20"), ({"lang": ("fr", None), "doc_id": (3000, None)}, "lang >= 'fr' AND doc_id >= 3000")):
        hit = {r["shard"] for r in sharding.touched(manifest, **ask).select("shard").collect()}
        assert set(of(where)) <= hit and len(hit) < 48, (ask, len(hit))


# --- 6: repacking within a partition ------------------------------------------------

def split_bins(seed, bins, capacity):
    """Lengths that fill ``bins`` bins without a gap."""
    r, out = random.Random(seed), []
    for _ in range(bins):
        a = sorted(r.sample(range(1, capacity), 3))
        out += [a[0], a[1] - a[0], a[2] - a[1], capacity - a[2]]
    r.shuffle(out)
    return out


def test_one_partition_is_repacked_to_its_bound(spark):
    missed = 0
    for seed in range(12):
        n = np.array(split_bins(seed, 14, 100))
        where, _ = packing.best_fit_decreasing(n, 100)
        if where.max() + 1 > 14:
            missed += 1
            better = packing.repaired(n, where, 14, 100)
            assert better.max() + 1 == 14 and np.bincount(better, weights=n).max() <= 100
    assert missed > 3
    n = next(x for x in (split_bins(s, 14, 100) for s in range(12)) if packing.best_fit_decreasing(np.array(x), 100)[0].max() + 1 > 14)
    rows = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(n)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(rows, 100).toPandas()
    assert out["sequence_id"].nunique() == 14 and len(out) == len(n)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 100


def test_repacking_leaves_what_is_best_alone():
    n = np.array([60, 60, 60])
    where, _ = packing.best_fit_decreasing(n, 100)
    assert packing.repaired(n, where, 2, 100).max() + 1 == 3
    assert packing.repaired(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 100).tolist() == []


# --- 4: scores by their definition --------------------------------------------------

def test_scores_are_sums_over_all_pairs_of_terms():
    """The log-odds of a text: bias, the weights of its known terms, and the product of the factors of every two of them."""
    r = np.random.default_rng(4)
    terms = np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    m = toxicity.Machine(terms, 5)
    m.bias, m.weight, m.factor = 0.3, r.normal(size=40), r.normal(size=(40, 5))
    texts = [np.sort(np.concatenate([r.choice(terms, n, replace=False), r.integers(0, 1 << 62, 3).astype(np.uint64)])) for n in (0, 1, 2, 9, 30)] + [np.zeros(0, np.uint64)]
    got = m.score(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for t, score in zip(texts, got, strict=True):
        k = [i for i, term in enumerate(terms) if term in set(t.tolist())]
        odds = m.bias + sum(m.weight[i] for i in k) + sum(float(m.factor[i] @ m.factor[j]) for a, i in enumerate(k) for j in k[a + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), abs=1e-12)


def test_toxicity_of_no_rows_long_texts_and_ties(spark, tmp_path):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(r.randint(0, 9)) for _ in range(n))
    rows = [(i, prose(30) + (" vile" if i % 4 == 0 else ""), "en", "s", 0, *CLASH) for i in range(400)]
    rows += [(500, prose(40_000) + " vile", "en", "s", 0, *CLASH), (501, prose(40_000), "en", "s", 0, *CLASH), (502, rows[0][1], "en", "s", 0, *CLASH), (502, rows[0][1], "en", "s", 0, *CLASH), (None, None, None, None, None, *CLASH)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(0, 0, 1), (None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op4_toxicity_fm(spark, str(tmp_path)).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert by[500]["predicted"] == 1 and by[501]["predicted"] == 0 and by[502]["score"] == pytest.approx(by[0]["score"], abs=1e-9) and by[None]["predicted"] == 0
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert sum(by[i]["predicted"] == int(i % 4 == 0) for i in range(400)) >= 396
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert toxicity.op4_toxicity_fm(spark, str(tmp_path / "none")).count() == 0
