"""The pipeline against its stages done by brute force on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_classes, copies, ids_by_library, prose
from wayfold.llm import decontamination, near_dup, packing, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    good = [prose(60) for _ in range(200)]
    item = prose(40)
    rows = [(i, t) for i, t in enumerate(good)] + [(300 + i, " ".join(w.upper() + "!!" for w in prose(50).split())) for i in range(120)]
    rows += [(500, good[0]), (501, good[1] + " more"), (502, prose(30) + " " + item + " " + prose(30)), (503, None), (504, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows if i < 500], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = near_dup.common.stored(stage(spark, docs, corpus), "test-stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {i for i in kept["quality"] if 300 <= i < 500} and set(range(200)) <= kept["quality"]
    assert kept["line_dedup"] == kept["quality"]
    assert 500 not in kept["near_dedup"] and 501 not in kept["near_dedup"] and 0 in kept["near_dedup"]
    assert len({503, 504} & kept["near_dedup"]) == 1
    assert kept["near_dedup"] - kept["decontamination"] == {502}


def test_run_packs_what_is_left(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).toPandas()
    assert 502 not in set(out["doc_id"]) and not set(range(300, 420)) & set(out["doc_id"])
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert out["sequence_id"].nunique() <= int(np.ceil(out["length"].sum() / 2048)) + 1


def without_repeated_lines(rows):
    """(id, text) without lines that later three-line windows cover, in the order of ids (null first)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ls, gone = (t or "").split("\n"), set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    """All stages on rows with a null doc_id, null and empty texts, shared lines, near copies and a benchmark item, with columns that clash with the operators' own."""
    shared = "\n".join(prose(8) for _ in range(4))
    item = prose(30)
    good = copies(12, 3, 90) + [prose(50) + "\n" + shared + "\n" + prose(20) for _ in range(6)] + [prose(20) + " " + item + " " + prose(20), item] + [prose(60) for _ in range(30)]
    rows = list(enumerate(good)) + [(100 + i, " ".join(w.upper() + "!!" for w in prose(50).split())) for i in range(40)] + [(None, prose(70)), (200, None), (201, ""), (202, "a b")]
    top = str(tmp_path)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, row string, __kept string")
    df.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")

    scores = {(r["doc_id"], r["text"]): r["s"] for r in df.select("doc_id", "text", quality.quality_score(df, spark.read.parquet(f"{top}/labels.parquet")).alias("s")).collect()}
    kept = without_repeated_lines([x for x in rows if scores[x] >= 0.5])
    key = lambda x: (x[0] is None, x[0] or 0)
    named = {(-1 if i is None else i): (i, t) for i, t in kept}
    classes = brute_classes([(k, t) for k, (_, t) in named.items()])
    one = [min((named[k] for k in c if k != -1), key=key, default=named[min(c)]) for c in classes]
    fold = lambda t: (t or "").lower().replace("\n", " ")
    want = sorted([x for x in one if fold(item) not in fold(x[1])], key=key)
    out = corpus_pipeline.run(spark, top).toPandas()
    lengths = {}
    for r in out.itertuples():
        i = None if np.isnan(r.doc_id) else int(r.doc_id)
        lengths[i] = lengths.get(i, 0) + r.length
    assert lengths == {i: len(ids_by_library(t)) for i, t in want}
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all() and (out.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
    assert out["sequence_id"].nunique() == packing.lower_bound(np.bincount(out["length"], minlength=packing.CAPACITY + 1))
    assert decontamination.budget(len(item)) > 0


def test_run_without_documents(spark, corpus, tmp_path):
    top = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    assert corpus_pipeline.run(spark, top).count() == 0
