"""Document fingerprints by a homomorphic multiset hash (operator 2), DataFrame functions only.

A text is the multiset of its paragraphs (cut at line feeds). Every paragraph is hashed to a wide vector, and the fingerprint is the
sum of the vectors, lane by lane modulo a power of two. So it doesn't depend on the order of paragraphs, and a paragraph is put in
or taken out by adding or subtracting its vector (``insert``, ``delete``).

The vector has two parts. ``EQUAL`` lanes modulo 2**32 are uniform words of a SHA-256-keyed hash of the whole paragraph: equal
fingerprints mean equal multisets. ``LIKE`` lanes modulo 2**20 sum a sign for each piece of the paragraph together with the piece after it, so that the difference
of two fingerprints estimates how many such pairs the texts don't share: the likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2), within 0 and 1. Pieces are the words of a paragraph, those of
more than ``PIECE`` code points cut, so that a text without blanks has pieces as any other; single letters in a paragraph of under ``SHORT`` code points. A piece that is said over and
over is told by its place too: as one element many times over its square would outweigh the rest.

Defined cases: null text counts as empty; a null doc_id comes first (as the least number); of rows that share a doc_id each gets its fingerprint, and the one
with the least opening stands for "the next document" of the id before; repeated rows get equal fingerprints, each its own row; an empty table gives no rows, and a lone document is its own
successor; a text of any length is taken whole, its pieces summed in chunks; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EQUAL, LIKE = 16, 64
#: Lanes are kept modulo these powers, and written as that many hex digits.
WORD, WORD_DIGITS, SIGN, SIGN_DIGITS = 1 << 32, 8, 1 << 20, 5
SUMS = LIKE // 4
#: Four 16-bit fields of a long; a chunk of elements is short enough not to carry from one to the next.
FIELDS, CHUNK = 0x0001000100010001, 32768
#: Paragraphs of a text that a chunk covers, with so many pieces of each that all are CHUNK at most.
PARAGRAPHS = 64
MAX_BUCKETS = 256
PIECE, SHORT = 8, 24
#: Stands for a null doc_id where rows are joined.
NO_ID = -(1 << 63)


def _hex(lanes: Column, digits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def _numbers(fingerprint: Column, start: int, count: int, digits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(fingerprint, i * digits + start, F.lit(digits)), 16, 10).cast("bigint"))


def _words(fingerprint: Column) -> Column:
    return _numbers(fingerprint, 1, EQUAL, WORD_DIGITS)


def _signs(fingerprint: Column) -> Column:
    return _numbers(fingerprint, EQUAL * WORD_DIGITS + 1, LIKE, SIGN_DIGITS)


def _combine(a: Column, b: Column, sign: int) -> Column:
    add = lambda x, y, power: F.zip_with(x, y, lambda p, q: F.pmod(p + sign * q, F.lit(power)))
    return F.concat(_hex(add(_words(a), _words(b), WORD), WORD_DIGITS), _hex(add(_signs(a), _signs(b), SIGN), SIGN_DIGITS))


def insert(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint of a text with further paragraphs, from the two fingerprints."""
    return _combine(fingerprint, paragraphs, 1)


def delete(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint without those paragraphs."""
    return _combine(fingerprint, paragraphs, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the LIKE lanes of two fingerprints; equal fingerprints give 1."""
    signed = lambda f: F.transform(_signs(f), lambda x: F.when(x >= SIGN // 2, x - SIGN).otherwise(x).cast("double"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    x, y = signed(a), signed(b)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    both = square(x) + square(y)
    return F.when((both == 0) | (a == b), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / F.greatest(both, F.lit(1.0))))


def fingerprints(docs: DataFrame, texts: list[str], keep: list[str], keys: int = 1) -> DataFrame:
    """``keep`` columns (longs; the first ``keys`` tell rows apart) and for each of ``texts`` its fingerprint, named ``fp_<text>`` (binary).

    Texts become paragraphs, a row each, and paragraphs elements, a row each, by generators that share one stage; whatever is hashed is hashed once it is a row, in generated code. The signs of an
    element are the bits of its hash, four to a long; a paragraph's first row brings its equal lanes instead, and a row of its own what else belongs to the document. All of them are ``SUMS`` longs,
    summed by one plain aggregate with no more in its key than the document, the text and a number for the chunk; chunks are short enough not to overflow a field. Where ``docs`` is partitioned by
    one of the keys already, nothing is exchanged: a row's elements are in its own task.
    """
    row, more = keep[:keys], keep[keys:]
    if len(more) > EQUAL:
        raise ValueError(f"no more than {EQUAL} columns go along")
    last = len(texts)
    every = [x for i, t in enumerate(texts) for x in (F.lit(i), F.col(t))] + [F.lit(last), F.lit("")]
    rows = docs.select(*keep, F.stack(F.lit(last + 1), *every).alias("w", "text"))
    rows = rows.select(*keep, "w", F.posexplode(F.split("text", "\n", -1)).alias("p", "para"))
    cut = F.when(F.length("para") < SHORT, F.regexp_extract_all("para", F.lit("[^ ]{1,1}"), F.lit(0))).otherwise(F.regexp_extract_all("para", F.lit("[^ ]{1,%d}" % PIECE), F.lit(0)))
    rows = rows.select(*keep, "w", "p", F.sha2("para", 256).alias("key"), cut.alias("q"))
    n = F.size("q")
    # the first row of a paragraph is no element; a piece has the next two beside it
    near = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("q")), F.concat(F.array(F.lit(None).cast("string")), F.slice("q", F.lit(2), n)), F.concat(F.array(F.lit(None).cast("string")), F.slice("q", F.lit(3), n)))
    rows = rows.select(*keep, "w", "p", "key", F.posexplode(near).alias("i", "e"))
    rows = rows.select(*keep, "w", "p", "key", F.col("i") - 1, *[F.col("e")[str(k)].alias(c) for k, c in enumerate("abc")]).toDF(*keep, "w", "p", "key", "i", "a", "b", "c")
    element = F.col("i") >= 0
    h = F.when(element, F.xxhash64("a", "b", F.when((F.col("a") == F.col("b")) | (F.col("a") == F.col("c")), F.col("i"))))
    part = F.when(element, F.floor(F.col("p") / PARAGRAPHS) * (1 << 23) + F.floor(F.col("i") / (CHUNK / PARAGRAPHS))).otherwise(-1).cast("long")
    rows = rows.select(*keep, "w", "key", "i", part.alias("chunk"), h.alias("h"))
    belongs = lambda k: F.when(F.col("w") == last, F.col(more[k]) if k < len(more) else F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(k), "key"), 32))
    value = lambda k: F.when(F.col("i") >= 0, F.shiftrightunsigned("h", k).bitwiseAND(F.lit(FIELDS))).otherwise(belongs(k))
    packed = rows.groupBy(*row, "w", "chunk").agg(*[F.sum(value(k)).alias(f"s{k}") for k in range(SUMS)], F.count("*").alias("n"))
    like, field = F.col("chunk") >= 0, lambda j: F.shiftrightunsigned(f"s{j % SUMS}", 16 * (j // SUMS)).bitwiseAND(F.lit(0xFFFF))
    whole = packed.groupBy(*row, "w").agg(
        *[F.sum(F.when(like, field(j)).otherwise(0)).alias(f"o{j}") for j in range(LIKE)], *[F.sum(F.when(~like, F.col(f"s{k}")).otherwise(0)).alias(f"e{k}") for k in range(EQUAL)], F.sum(F.when(like, F.col("n")).otherwise(0)).alias("n")
    )
    whole = whole.select(*row, "w", "n", F.array(*[F.col(f"o{j}") for j in range(LIKE)]).alias("o"), F.array(*[F.col(f"e{k}") for k in range(EQUAL)]).alias("e"))
    signs = F.transform("o", lambda x: F.pmod(2 * x - F.col("n"), F.lit(SIGN)))
    lanes = F.concat(_hex(F.transform("e", lambda x: F.pmod(x, F.lit(WORD))), WORD_DIGITS), _hex(signs, SIGN_DIGITS))
    each = whole.select(*row, "w", "e", F.when(F.col("w") < last, F.unhex(lanes)).alias("fp"))
    got = each.groupBy(*row).agg(*[F.max(F.when(F.col("w") == i, F.col("fp"))).alias(f"fp_{t}") for i, t in enumerate(texts)], F.max(F.when(F.col("w") == last, F.col("e"))).alias("own"))
    return got.select(*row, *[F.col("own")[k].alias(c) for k, c in enumerate(more)], *[f"fp_{t}" for t in texts])


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (id, need; ids distinct) with next_id: the id after it in ascending order, round to the first.

    Ids are dealt over ranges by approximate quantiles (a fixed number); only one row a range meets in one window.
    """
    n = min(MAX_BUCKETS, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = keys.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    dealt = keys.select("id", "need", F.size(F.filter(bounds, lambda c: c <= F.col("id"))).alias("b"))
    rows = dealt.withColumn("__next", F.lead("id").over(Window.partitionBy("b").orderBy("id")))
    whole = Window.orderBy("b")
    ends = dealt.groupBy("b").agg(F.min("id").alias("low"))
    ends = ends.select(F.col("b").alias("__b"), F.coalesce(F.lead("low").over(whole), F.first("low").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__low"))
    joined = rows.join(F.broadcast(ends), F.col("b") == F.col("__b"))  # MAX_BUCKETS rows
    return joined.select("id", "need", F.coalesce("__next", "__low").alias("next_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """id, text, next_id, edited: the last floor(n/4) code points replaced by the first as many of the next document.

    Both joins read the same exchange of the texts; what is sent to meet them is the openings, a quarter of a text each.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), common.text_or_empty().alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    links = successors(rows.groupBy("id").agg(F.max(quarter).alias("need")))
    links = links.select(F.col("id").alias("from_id"), "need", F.col("next_id").alias("to_id"))
    heads = rows.join(links, F.col("id") == F.col("to_id")).select("from_id", "to_id", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    heads = heads.groupBy("from_id").agg(F.min("to_id").alias("next_id"), F.min("head").alias("head"))
    both = rows.join(heads, F.col("id") == F.col("from_id"))
    return both.select("id", "text", "next_id", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("head", F.lit(1), quarter)).alias("edited"))


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = F.sha2("edited", 256)
    quarter = lambda k: F.shiftleft(F.conv(F.substring(F.col("sha"), 16 * k + 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(F.col("sha"), 16 * k + 9, 8), 16, 10).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "next_id", F.length("text").cast("long").alias("n_chars"), sha.alias("sha"), "text", "edited")
    rows = rows.select("id", "row", "next_id", "n_chars", *[quarter(k).alias(f"sha{k}") for k in range(4)], "text", "edited")
    done = common.stored(fingerprints(rows, ["text", "edited"], ["id", "row", "next_id", "n_chars", *[f"sha{k}" for k in range(4)]], keys=2), "fingerprints")
    after = done.groupBy(F.col("id").alias("after_id")).agg(F.min("fp_text").alias("fp_next"))
    both = done.join(after, F.col("next_id") == F.col("after_id"))
    own, edited, next_ = (F.lower(F.hex(f"fp_{x}")) for x in ("text", "edited", "next"))
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"sha{k}")), 16, "0") for k in range(4)])
    both = both.select("id", "n_chars", digest.alias("edited_sha256"), own.alias("fingerprint"), edited.alias("edited_fingerprint"), next_.alias("next_fingerprint"))
    return both.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
