"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import chat, decontamination, fingerprints, lines, near_dup, packing, quality, repeats, token_store, tokens, toxicity, words

DOCS = "doc_id long, text string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_docs():
    base = prose(120)
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (5, "x"), (None, prose(30)), (6, "a b c"), (7, prose(6000)), (8, " \n\n\t "), (9, base + " tail words here"), (9, "another text of one id"), (10, "日本 語 — ok. It's")]
    return rows


ODD = odd_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------

def test_chat_collapses_snapshots(spark):
    talk = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "more"), ("assistant", None)]
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3)):
        rows += [(conv, i, *talk[i]) for i in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other")]  # shares a first turn only
    rows += [(6, 0, "user", "hi"), (6, 0, "user", "hi")]  # a repeated row; then a prefix
    rows += [(None, 0, "user", "alone"), (7, None, None, "x"), (7, 0, "b", "t"), (7, 0, "a", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", pa_lit())
    rows = chat.chat_format(df).collect()
    got = {r["conv_id"]: r for r in rows}
    assert len(rows) == len(got)
    assert set(got) == {2, 5, None, 7}
    assert got[2]["n_turns"] == 4 and got[2]["n_copies"] == 2
    assert got[2]["text"].count(chat.CLOSE) == 4 and "hello < |im_end|>" in got[2]["text"]
    seven = got[7]["text"]  # a null turn is a block of its own, the first
    assert seven.index("\nx") < seven.index("a\nt") < seven.index("b\nt")


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_chat_blocks_do_not_matter(spark):
    rows = [(c, i, "user", f"t{i}") for c, n in ((1, 700), (2, 300), (3, 701)) for i in range(n)] + [(4, 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = {r["conv_id"] for r in chat.chat_format(df, 10_000).collect()}
    small = chat.chat_format(df, 64).collect()
    assert wide == {r["conv_id"] for r in small} == {3, 4}
    assert len(small) == 2
    text = next(r["text"] for r in small if r["conv_id"] == 3)
    assert text == "".join(f"{chat.OPEN}user\nt{i}{chat.CLOSE}\n" for i in range(701))
    parts = sorted((r["piece"], r["text"]) for r in chat.chat_format(df, 64, whole=False).filter("conv_id = 3").collect())
    assert [p for p, _ in parts] == list(range(11)) and "".join(t for _, t in parts) == text
    sparse = spark.createDataFrame([(1, 1000 * i, "user", f"t{i}") for i in range(300)], df.schema)
    assert [(r["n_turns"], r["text"].count(chat.OPEN)) for r in chat.chat_format(sparse).collect()] == [(300, 300)]
    assert chat.chat_format(df.limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------

def test_fingerprints_contract(spark, tmp_path, docs):
    rows = [(5, "one two\nthree four"), (2, "three four\none two"), (9, "one two\nthree four"), (None, None), (11, prose(3000) + "\n" + prose(50))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op2_multiset_fingerprints(spark, str(tmp_path)).collect()}
    assert got[5]["fingerprint"] == got[2]["fingerprint"] == got[9]["fingerprint"] != got[11]["fingerprint"]
    ordered = [None, 2, 5, 9, 11]
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(ordered):
        t, nxt = texts[i], texts[ordered[(k + 1) % 5]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[2]["near_next"] == 1.0
    assert got[11]["near_edited"] > 0.6 > got[11]["near_next"]


def test_likeness_of_texts_without_blanks_of_runs_and_of_short_texts(spark, tmp_path, none):
    r = random.Random(4)
    wide = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    rows = [(1, wide(401)), (2, wide(300)), (3, prose(80)), (4, ("die " * 300).strip()), (5, prose(90)), (6, "That it."), (6, "That it."), (7, "another one")]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("row", "id", "n_chars", "fp_text"):
        df = df.withColumn(c, pa_lit())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op2_multiset_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and not [(x["doc_id"], x["near_edited"]) for x in got if x["near_edited"] <= (0.4 if x["n_chars"] > 50 else 0.1)] and not [(x["doc_id"], x["near_next"]) for x in got if x["near_next"] >= 0.4 and x["doc_id"] < 6]
    assert len({x["fingerprint"] for x in got if x["doc_id"] == 6}) == 1
    none.write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert fingerprints.op2_multiset_fingerprints(spark, str(tmp_path / "empty")).count() == 0


def test_fingerprints_match_a_plain_sum(spark):
    """Lanes against their definition: uniform words of every paragraph's key, and a sign for each bit of every pair's hash."""
    from pyspark.sql import functions as F

    texts = ["", "one two\none two", prose(40) + "\n" + "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {x["k"]: x["f"] for x in fingerprints.fingerprints(df, ["text"], ["k"]).select("k", F.lower(F.hex("fp_text")).alias("f")).collect()}
    for k, t in enumerate(texts):
        equal, like = [0] * 16, [0] * 64
        for p in t.split("\n"):
            key = hashlib.sha256(p.encode()).hexdigest()
            lanes = spark.range(1).select(*[F.xxhash64(F.lit(i), F.lit(key)) for i in range(16)]).first()
            equal = [(a + ((b & (1 << 64) - 1) >> 32)) % 2**32 for a, b in zip(equal, lanes, strict=True)]
            pieces = re.findall("[^ ]{1,%d}" % (1 if len(p) < 24 else 8), p)
            ahead = [*pieces, None, None]
            for i, a in enumerate(pieces):
                place = i if a in ahead[i + 1 : i + 3] else None
                h = spark.range(1).select(F.xxhash64(F.lit(a), F.lit(ahead[i + 1]).cast("string"), F.lit(place).cast("int"))).first()[0]
                for j in range(64):
                    like[j] += 1 if (h >> (j % 16 + 16 * (j // 16))) & 1 else -1
        assert got[k] == "".join(f"{x:08x}" for x in equal) + "".join(f"{x % (1 << 20):05x}" for x in like)


def test_fingerprints_take_paragraphs_in_and_out(spark):
    from pyspark.sql import functions as F

    def of(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
        return [r["f"] for r in fingerprints.fingerprints(df, ["text"], ["k"]).select("k", F.lower(F.hex("fp_text")).alias("f")).orderBy("k").collect()]

    a, b, both = of("p one\np two", "q three", "p one\np two\nq three")
    df = spark.createDataFrame([(a, b, both)], "a string, b string, c string")
    r = df.select(fingerprints.insert(F.col("a"), F.col("b")).alias("i"), fingerprints.delete(F.col("c"), F.col("b")).alias("d")).first()
    assert r["i"] == both and r["d"] == a


def test_fingerprints_of_long_texts_use_several_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(0, prose(900)), (1, "a")], "k int, text string")
    whole = sorted(map(tuple, fingerprints.fingerprints(df, ["text"], ["k"]).collect()))
    monkeypatch.setattr(fingerprints, "CHUNK", 640)
    monkeypatch.setattr(fingerprints, "PARAGRAPHS", 2)
    assert sorted(map(tuple, fingerprints.fingerprints(df, ["text"], ["k"]).collect())) == whole


# --- 3 and 4 -----------------------------------------------------------------------

def test_quality_learns_and_handles_odd_rows(spark, docs):
    rows = [(i, prose(40) if i % 2 else " ".join(w.upper() + "!!" for w in prose(40).split())) for i in range(300)]
    d = spark.createDataFrame(rows + [(1000, None), (1001, "")], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", quality.quality_score(d, labels).alias("s")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert d.limit(0).select(quality.quality_score(d.limit(0), labels.limit(0)).alias("s")).count() == 0


def test_toxicity_learns_pairs_with_the_settings_of_the_query(spark):
    """Two words that are harmless alone and toxic together or apart: no linear weights could tell, and neither tells anything by itself."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words_ = ["left"] * a + ["right"] * b + r.sample(WORDS, 5)
        r.shuffle(words_)
        rows.append((i, " ".join(words_))), labels.append((i, 1, int(a == b)))
    d, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["s"] for x in d.select("doc_id", toxicity.toxicity_score(d, y).alias("s")).collect()}
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == (labels[i][2] == 1) for i in held]) > 0.9


def test_classifier_queries_mark_what_is_held_out(spark, tmp_path):
    rows = [(i, prose(30) + (" vileword" if i % 3 == 0 else "") if i % 2 else " ".join(w.upper() + "!!" for w in prose(30).split()) + (" vileword" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(300, None), (300, ""), (301, prose(20)), (301, prose(20)), (None, prose(10))]
    top = str(tmp_path)
    spark.createDataFrame([(i, t, "key", "score") for i, t in rows], "doc_id long, text string, key string, score string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(240)] + [(301, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    for query, modulus, rest, least in ((quality.op3_quality_vote, 3, 1, 0.5), (toxicity.op4_toxicity_fm, 4, 2, 0.3)):
        got = query(spark, top).collect()
        assert len(got) == len(rows) and {"doc_id", "held_out", "score", "predicted"} <= set(got[0].asDict())
        for x in got:
            if x["doc_id"] is not None:
                assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % modulus == rest)
            assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= least)
        wrong = [x["doc_id"] for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 240 and x["predicted"] != (x["doc_id"] % 2 if modulus == 3 else int(x["doc_id"] % 3 == 0))]
        assert len(wrong) <= 3


def test_votes_match_brute_force():
    """Scores against a plain evaluation of the definition: every cosine, the nearest sorted, votes weighted by similarity and by what the sample's balance hides."""
    r = random.Random(2)
    raw = [(prose(30, r) if i % 2 else prose(30, r).upper()).encode() for i in range(60)] + [b"", b"ab"]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    counts = quality.term_counts(np.frombuffer(b"".join(raw), np.uint8), at)
    y = np.array([i % 2 for i in range(40)], np.float32)
    m = quality.Model(62, (counts > 0).sum(0), counts[:40], y, 0.8)
    got = m.score(counts)
    for i in range(62):
        if not counts[i].sum():
            assert got[i] == 0.8
            continue
        x = np.log1p(counts[i]) * m.idf
        z = (x / np.linalg.norm(x)) @ m.to_latent
        cos = m.latent @ (z / max(np.linalg.norm(z), 1e-12))
        top = sorted(range(40), key=lambda j: -cos[j])[: quality.NEIGHBOURS]
        w = {j: np.exp(quality.SHARP * (cos[j] - cos[top[0]])) * (0.8 / 0.5 if y[j] else 0.2 / 0.5) for j in top}
        assert abs(got[i] - sum(w[j] * y[j] for j in top) / sum(w.values())) < 1e-3


def test_term_counts_of_stretches_are_those_of_whole_texts():
    raw = [t.encode() for t in ("", "ab", "the the cat", prose(50), "日本 語" * 9, "x")]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    d = np.frombuffer(b"".join(raw), np.uint8)
    whole = quality.term_counts(d, at)
    assert whole[3, : quality.HALF].sum() == len(raw[3]) - 2 and whole[1].sum() == 1
    for stretch in (1, 2, 3, 7, 50):
        assert (quality.term_counts(d, at, stretch) == whole).all()


def test_toxicity_scores_all_rows(spark, docs):
    rows = [(i, prose(30) + (" vileword " if i % 3 == 0 else " ") + prose(5)) for i in range(300)] + ODD[:2]
    d = spark.createDataFrame([(i + 5000 if i is not None and i < 3 and t in (None, "") else i, t) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.toxicity_score(d, labels).alias("s")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())


# --- 5 -------------------------------------------------------------------------------

def covered(texts, n=repeats.LENGTH):
    seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        out.append(bytes(m))
    return out


def repeat_rows():
    r = random.Random(3)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(150, 700))) for _ in range(5)] + ["xy" * 400]
    rows = []
    for i in range(40):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(parts)
            a = r.randrange(len(p))
            t += p[a : a + r.randint(100, 600)] + "".join(r.choice("abcdé ") for _ in range(r.randint(0, 50)))
        rows.append((i, t))
    return rows + [(100, None), (101, ""), (None, parts[0])]


@pytest.mark.parametrize("crowd", [3000, 1])
def test_repeats_match_brute_force(spark, crowd):
    rows = repeat_rows()
    texts = [(t or "").encode() for _, t in rows]
    got = {r["doc_id"]: r for r in repeats.repeats(spark.createDataFrame(rows, DOCS), crowd).collect()}
    for (i, _), raw, mask in zip(rows, texts, covered(texts), strict=True):
        kept = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest())


def test_repeats_of_rows_that_share_an_id(spark, none):
    t = prose(80)
    got = repeats.repeats(spark.createDataFrame([(1, t), (1, t), (1, "short")], DOCS)).collect()
    assert sorted(r["n_removed"] for r in got) == sorted([len(t.encode())] * 2 + [0])
    assert repeats.repeats(none).count() == 0


def test_long_texts_are_searched_in_stretches(monkeypatch):
    rows = [t.encode() for _, t in repeat_rows() if t] + [(prose(300) * 2).encode()]
    at = np.concatenate([[0], np.cumsum([len(b) for b in rows])]).astype(np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)

    def windows():
        return {(int(t), int(s) + k, int(g)) for t, s, n, g, _ in zip(*repeats.contexts(data, at), strict=True) for k in range(n)}

    whole = windows()
    monkeypatch.setattr(repeats, "STRETCH", 900)
    assert windows() == whole and len(whole) == sum(max(0, len(b) - 199) for b in rows)


def test_matching_statistics_are_exact():
    r = random.Random(5)
    text = np.frombuffer("".join(r.choice("ab") for _ in range(300)).encode() + b"\xff", np.uint8)
    raw = text.tobytes()
    got = repeats.matching_statistics(text, 64)
    for i in range(len(raw) - 1):
        best = max(next((k for k in range(len(raw)) if i + k >= len(raw) or j + k >= len(raw) or raw[i + k] != raw[j + k]), 0) for j in range(len(raw)) if j != i)
        assert min(best, 64) <= got[i] + 0 or got[i] >= 64
        assert got[i] <= best or got[i] >= 64


# --- 6 and 9 -----------------------------------------------------------------------------

def ids_by_library(text):
    """Ids by the untouched library, with the end id."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [0]


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_path(), cached=500)
    r = random.Random(1)
    pieces = ["a", "B", "é", "ß", ",", ".", "\n", " ", "  ", "\t", "'s", "!!", "1", "×", "中", "\x01", "—", "don't", "\r\n", "<|endoftext|>", "x" * 200]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [prose(200) for _ in range(10)]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    flat, ends = e.encode(np.frombuffer(b"".join(raw), np.uint8), at, 0)
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [0]


def test_long_texts_are_encoded_in_stretches():
    encoder = tokens.Encoder(tokens.default_path())
    r = random.Random(3)
    raw = [t.encode() for t in ("", prose(900, r), "x" * 700, prose(40, r) + "\n\n" + "日本" * 200 + prose(200, r), "", "ab  cd " * 90, "y" * 30 + " " + "z" * 900)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    d = np.frombuffer(b"".join(raw), np.uint8)
    whole = encoder.encode(d, at, 0)
    for stretch in (64, 200, 1000):
        part = encoder.encode(d, at, 0, stretch)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_special_tokens_are_those_of_the_untouched_library():
    from tokenizers import Tokenizer

    plain, e, r = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), cached=500), random.Random(2)
    assert e.with_end("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]
    pieces = ["<|endoftext|>", "<|endoftext|>", "a", "é", "it's", "'s", ",", ".", " ", "  ", "\n", "\t", "\x01", "1", "<|", "|>", "\u00a0", "x" * 150]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 15))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    flat, ends = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]), 0)
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [0], t


def test_packing_places_every_piece(spark, docs, none):
    got = packing.pack_documents(docs).toPandas()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(ids_of(t))
    assert got["length"].sum() == sum(len(x) for v in texts.values() for x in v)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.cumsum(seq["length"]) - seq["length"]).all() and seq["length"].sum() <= 2048
    long = got[got.doc_id == 7].sort_values("piece")
    assert (long["length"].iloc[1:] == 2048).all() and long["start"].tolist() == (np.cumsum(long["length"]) - long["length"]).tolist()
    ids = np.array(texts[7][0], "<u4")
    assert long["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long["start"], long["length"], strict=True)]
    assert packing.pack_documents(none).count() == 0


def test_packing_in_many_partitions_meets_the_bound(spark):
    r = np.random.default_rng(2)
    n = r.integers(1, 1500, 4000).tolist()
    rows = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(n)], packing.PIECES)
    out = packing.pack(rows, per_part=500).toPandas()
    assert len(out) == len(n) and (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    least = packing.lower_bound(np.bincount(n, minlength=2049))
    assert least >= -(-sum(n) // 2048)
    assert out["sequence_id"].nunique() <= 1.02 * least


def test_lower_bound_never_exceeds_the_best_packing():
    r = random.Random(4)
    for _ in range(200):
        n = [r.randint(1, 12) for _ in range(7)]

        def least(left, rooms):
            if not left:
                return len(rooms)
            best = len(n)
            for k in range(len(rooms)):
                if rooms[k] >= left[0]:
                    best = min(best, least(left[1:], rooms[:k] + [rooms[k] - left[0]] + rooms[k + 1 :]))
            return min(best, least(left[1:], [*rooms, 12 - left[0]])) if len(rooms) + 1 <= best else best

        assert packing.lower_bound(np.bincount(n, minlength=13), 12) <= least(sorted(n, reverse=True), [])


def test_token_store_reads_back_what_it_wrote(spark, docs, none):
    got = token_store.token_store(spark, docs).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array(ids_of(t), "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.token_store(spark, none).count() == 0


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    k = np.zeros(5000, token_store.KEY)
    k["doc_id"] = np.arange(-2500, 2500) * 7919
    index = token_store.PerfectHash.build(token_store.key_hash(k))
    again = token_store.PerfectHash.from_bytes(index.to_bytes())
    assert sorted(again.slots(token_store.key_hash(k)).tolist()) == list(range(5000))


# --- 7 ------------------------------------------------------------------------------------

def test_line_dedup_matches_brute_force(spark, none):
    r = random.Random(9)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for i in range(60)] + [(100, None), (101, ""), (7, "a\nb\nc\na\nb\nc"), (None, "a\nb\nc\nd")]
    rows = [(i, t) for k, (i, t) in enumerate(rows) if i not in {x for x, _ in rows[:k]}]
    seen, exp = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ls = (t or "").split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        exp[i] = t if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_chars long, hits string")
    for c in ("__key", "__hits", "__kept", "key", "kept", "row", "a.b"):
        df = df.withColumn(c, pa_lit())
    out = lines.line_dedup(df)
    assert out.columns == df.columns and all(r["__key"] == r["kept"] == r["a.b"] == "clash" for r in out.collect())
    assert {r["doc_id"]: r["text"] for r in out.collect()} == exp
    assert lines.line_dedup(none).count() == 0
    same = spark.createDataFrame([(1, "a\nb\nc")] * 2, DOCS)
    assert [r["text"] for r in lines.line_dedup(same).collect()] == ["a\nb\nc"] * 2


# --- 8 -------------------------------------------------------------------------------------

def test_leaks_within_the_budget_are_found(spark):
    r = random.Random(3)
    items = [(i, prose(r.randint(14, 50), r)) for i in range(30)] + [(50, None), (51, ""), (52, "tiny#")]
    rows = []
    for i, t in items[:30]:
        s, e = list(t), decontamination.budget(len(t.encode()))
        for _ in range(r.randint(0, e // 2)):
            s[r.randrange(len(s))] = r.choice("abc")
        rows.append((i, prose(60, r) + " " + "".join(s).replace(" ", "\n", 2).upper().lower() + " " + prose(60, r)))
    clean = [(1000 + i, prose(200, r)) for i in range(40)]
    d = spark.createDataFrame(rows + clean + [(2000, None), (2001, ""), (2002, "has tiny# inside"), (2003, prose(30000, r) + items[3][1])], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontamination.leaks(d, b).collect()}
    assert all(i in got[i] for i in range(30)) and got[2002] == {52} and 3 in got[2003]
    assert all(i not in got for i, _ in clean) and 2000 not in got and 2001 not in got
    assert decontamination.leaks(d, b.limit(0)).count() == 0 and decontamination.leaks(d.limit(0), b).count() == 0
    named = d.withColumn("hits", pa_lit()).withColumn("key", pa_lit()).unionByName(d.filter("doc_id = 2002").withColumn("hits", pa_lit()).withColumn("key", pa_lit()))
    kept = decontamination.clean(named, b)
    assert kept.columns == named.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean} | {2000, 2001}


def test_leaks_match_brute_force_over_several_blocks(spark, monkeypatch):
    """Whole texts against every item by the full edit-distance table, with a benchmark of several blocks; repeated rows are one document."""
    r = random.Random(11)
    items = [(i, prose(r.randint(4, 8), r)) for i in range(14)]
    rows = []
    for i in range(40):
        s = list(items[i % 14][1])
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(s))
            s[k : k + 1] = [r.choice("xyz")] if r.random() < 0.6 else []
        rows.append((i, (prose(r.randint(0, 12), r) + " " + "".join(s[:200]) + " " + prose(r.randint(0, 12), r))[:400]))
    rows += [rows[0], (100, None), (101, prose(3, r))]

    def fold(t):
        return bytes(x if x not in range(9, 14) else 32 for x in (t or "").encode().lower())

    def least(item, text):
        row = np.zeros(len(text) + 1, int)
        for i, x in enumerate(item, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (np.frombuffer(text, np.uint8) != x), row[1:] + 1)
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return int(row.min())

    want = {}
    for i, t in rows:
        hits = {(k, least(fold(x), fold(t))) for k, x in items if least(fold(x), fold(t)) <= decontamination.budget(len(fold(x)))}
        if hits:
            want[i] = hits
    monkeypatch.setattr(decontamination, "blocks", lambda b, size=120, real=decontamination.blocks: real(b, size))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontamination.blocks(b))) > 3
    df = spark.createDataFrame(rows, DOCS)
    found = decontamination.leaks(df, b).collect()
    got = {}
    for x in found:
        for h in x["hits"]:
            e = got.setdefault(x["doc_id"], {})
            e[h["item_id"]] = min(h["edits"], e.get(h["item_id"], 99))
    assert len(found) == len({x["doc_id"] for x in found}) and {i: set(h.items()) for i, h in got.items()} == want
    assert {x["doc_id"] for x in decontamination.clean(df, b).collect()} == {i for i, _ in rows} - set(want)


def test_banded_alignment_gives_the_edit_distance():
    r = random.Random(6)
    for _ in range(60):
        item = "".join(r.choice("ab") for _ in range(20))
        s = list(item)
        for _ in range(r.randint(0, 3)):
            s[r.randrange(len(s)) : r.randrange(len(s)) + 1] = [r.choice("abc")] if r.random() < 0.7 else []
        region = "c" * r.randint(0, 5) + "".join(s) + "c" * r.randint(0, 9)
        row = list(range(0, 1)) * (len(region) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(region, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(row)
        found = decontamination.aligned(np.frombuffer(item.encode(), np.uint8), np.frombuffer(region.encode(), np.uint8), 12, 60)
        assert (found[0] if found else 13) == min(best, 13)


def test_benchmarks_larger_than_a_block(spark):
    items = [(i, prose(30)) for i in range(12)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontamination.blocks(b, 300))) > 3
    assert sorted(i for block in decontamination.blocks(b, 300) for i, _ in block) == list(range(12))


# --- 10 -------------------------------------------------------------------------------------

def bag(t):
    """Five-word shingles; words are runs of letters and digits, ASCII ones in lower case."""
    w = re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and 2 * sum((a & b).values()) >= 0.8 * sum((a + b).values())):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {frozenset(g) for g in groups.values()}


def copies(n, seed, words=150):
    r = random.Random(seed)
    base = [r.choice(WORDS) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(words)] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 9])
def test_near_duplicates_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = copies(60, 1) + copies(40, 2) + [prose(60) for _ in range(20)] + ["", None, "a b", "a  b", "a b c d e f", ("ha " * 40).strip(), ("ha " * 45).strip()]
    rows = list(enumerate(texts))
    got = near_dup.classes(spark.createDataFrame(rows, DOCS).withColumn("bands", pa_lit())).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in groups.values()} == brute_classes(rows)
    assert all(min(g) == k for k, g in groups.items())


def test_signatures_are_unbiased():
    r = random.Random(8)
    est, true = [], []
    for _ in range(120):
        a = [r.choice(WORDS) for _ in range(r.randint(20, 120))]
        b = a[: r.randrange(len(a))] + a[: r.randrange(len(a))] + [r.choice(WORDS) for _ in range(r.randint(0, 30))]
        x, y = " ".join(a), " ".join(b or ["z"])
        raw = [x.encode(), y.encode()]
        s = near_dup.signatures(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), sum(map(len, raw))]))
        est.append((s[0] == s[1]).mean())
        p, q = bag(x), bag(y)
        true.append(sum((p & q).values()) / sum((p | q).values()))
        assert abs(near_dup.similarity(x, y) - 2 * sum((p & q).values()) / sum((p + q).values())) < 1e-12
    assert abs(np.mean(np.array(est) - true)) < 0.012


def test_blocks_by_bytes_and_outsiders_of_a_hot_bucket(spark, monkeypatch):
    """One bucket holds two classes and outsiders; whatever the blocks, classes are those of brute force."""
    texts = copies(30, 5, 60) + copies(12, 6, 60) + [prose(60) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = df.selectExpr("1L AS bucket", "node", "octet_length(text) AS size", "CASE WHEN node < 20 THEN 0L ELSE node END AS root")
    want = {g for g in brute_classes(list(enumerate(texts)))}
    for block, size in ((512, 1 << 24), (4, 1 << 24), (512, 1500)):
        links = [(r["u"], r["v"]) for r in near_dup.compared(members, df, block, size).collect()]
        up = {i: 0 if i < 20 else i for i in range(len(texts))}
        for _ in texts:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
            up = {i: min(up[i], up[up[i]]) for i in up}
        groups = defaultdict(set)
        for i, r in up.items():
            groups[r].add(i)
        joined = {frozenset(g) for g in groups.values()}
        assert all(any(w <= g for g in joined) for w in want) and len(joined) <= len(want)


def test_roots_are_the_least_nodes_of_components(spark):
    from wayfold.llm import components

    r = random.Random(6)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(25)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {(x["u"], x["v"]) for x in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, m) for x, m in up.items() if x != m}
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_stretches_are_those_of_whole_texts():
    raw = [t.encode() for t in ("", "ab é, cd.", "x" * 50, " ", "日本 語", "a b c d e f g h")]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    d = np.frombuffer(b"".join(raw), np.uint8)
    for table in (words.BLANKS, words.LETTERS, words.WORDS):
        whole = words.word_hashes(d, at, table)
        for stretch in (1, 3, 7, 30):
            part = words.word_hashes(d, at, table, stretch)
            assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_one_of_each_keeps_one_row(spark, docs, none):
    clash = ["root", "key", "row", "id", "kept_id", "__key", "a.b"]
    own = docs
    for c in clash:
        own = own.withColumn(c, pa_lit())
    out = near_dup.one_of_each(own)
    texts = [t or "" for _, t in ODD]
    assert out.columns == ["doc_id", "text", *clash] and all(r[2] == own.first()[2] for r in out.collect())
    got = sorted((r["text"] or "") for r in out.collect())
    assert len(got) == len(set(got)) and set(got) <= set(texts) and near_dup.one_of_each(none).count() == 0


def test_stored_tables_are_cleaned_up(spark):
    from wayfold.llm import common

    df = common.stored(spark.range(5), "clean-up")
    path = spark._wayfold_paths[-1]
    assert df.count() == 5
    common.clean_up(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# --- the registered queries over a small folder ---------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nulls, empty and repeated rows, a long text, shared passages, and columns named as the operators name their own."""
    top = str(tmp_path_factory.mktemp("queries"))
    df = spark.createDataFrame(QUERY_ROWS, DOCS)
    for c in ("key", "row", "root", "bucket", "node", "size", "start", "piece", "length", "ref", "gram", "ctx", "spans", "part", "fill", "hits", "pass", "bands", "digest", "n_tokens", "__key"):
        df = df.withColumn(c, pa_lit())
    df.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, QUERY_ITEM), (2, QUERY_ITEM), (3, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


QUERY_ITEM = prose(25)
QUERY_ROWS = [*ODD, *enumerate(copies(8, 21, 120), 100), (200, prose(10) + " " + QUERY_ITEM + " " + prose(400)), (201, prose(30) + " <|endoftext|> x"), (202, prose(300) * 2), (203, "é" * 500)]


def texts_by_id():
    out = defaultdict(list)
    for i, t in QUERY_ROWS:
        out[i].append(t or "")
    return out


def test_query_of_repeats(spark, folder):
    got = repeats.op5_run_length_index(spark, folder).collect()
    raw = [(t or "").encode() for _, t in QUERY_ROWS]
    want = Counter()
    for (i, _), b, m in zip(QUERY_ROWS, raw, covered(raw), strict=True):
        kept = bytes(c for c, x in zip(b, m, strict=True) if not x)
        want[i, len(b), sum(m), sum(x and (k == 0 or not m[k - 1]) for k, x in enumerate(m)), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_query_of_packing(spark, folder):
    got = packing.op6_best_fit_packing(spark, folder).collect()
    ids = [(i, ids_by_library(t)) for i, t in QUERY_ROWS]
    want = Counter()
    for i, x in ids:
        at = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b[:-1]])) and sum(n for _, n in b) <= 2048
    assert len(bins) == packing.lower_bound(np.bincount([r["length"] for r in got], minlength=2049))


def test_query_of_leaks(spark, folder):
    got = decontamination.op8_benchmark_leaks(spark, folder).collect()
    assert [(r["doc_id"], r["item_ids"], r["n_hits"], r["least_edits"]) for r in got] == [(200, [1, 2], 2, 0)]


def test_query_of_token_store(spark, folder):
    got = sorted(map(tuple, token_store.op9_token_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    rows = sorted(QUERY_ROWS, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = ids_by_library(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_query_of_near_duplicates(spark, folder):
    got = near_dup.op10_bagminhash(spark, folder).collect()
    assert len(got) == len(QUERY_ROWS)
    rows = list(enumerate(QUERY_ROWS))
    classes = brute_classes([(k, t) for k, (_, t) in rows])
    want = Counter()
    for c in classes:
        ids = [QUERY_ROWS[k][0] for k in c]
        low = min((i for i in ids if i is not None), default=None)
        want.update((i, low) for i in ids)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want


def test_one_doc_id_may_hold_most_rows(spark):
    """A doc_id with most of the rows is dealt over shards by its texts, in order."""
    rows = [(1, prose(5)) for _ in range(200)] + [(2, prose(5))]
    got = sorted(map(tuple, token_store.token_store(spark, spark.createDataFrame(rows, DOCS)).collect()), key=lambda r: r[1])
    want = [len(ids_by_library(t)) for _, t in sorted(rows, key=lambda x: (x[0], x[1].encode()))]
    assert [r[2] for r in got] == want and [r[1] for r in got] == list(np.cumsum([0, *want[:-1]]))
