"""How far the sources of a language stand apart in their words (operator 12), by integer-dictionary encoding.

Words are counted by (lang, source, word) with the number of documents that have them; those in fewer than ``LEAST`` documents of the language go. What is left is range-partitioned by (lang, word) and
sorted, so each task has stretches of the language's dictionary: a sorted array of words, whose places are the ids. Cells are encoded by searching them in that array, and a count for each id and source
makes the stretch's dense vectors. Ids ascend with UTF-8, so equal values are told by id.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)) for every kept word, present or not; the divergence of p from q is floor((p - q)^2 / q). A task sums what its stretches add to each pair of sources,
and keeps each source's ``TOP`` words of a stretch; sums and tops are put together by one more grouping. Whole numbers throughout.

Defined cases: null text, lang and source are ''; a source without words has the share of absent words; a language without kept words gives its pairs with value 0; a lone source has no pairs; equal values
rank by item in UTF-8 order; repeated rows and rows that share a doc_id are documents of their own; a text of any length is read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

LEAST, TOP, UNIT = 3, 200, 1_000_000_000
#: Parts that a source's candidates are dealt over before its tops are taken.
SPREAD = 16
#: Words of a stretch, at most, and entries of the dense vectors (sources x words) worked on at once.
STRETCH, DENSE = 4096, 1 << 22
#: Bytes of text that a task splits into words at once.
TEXT = 4 << 20
_TABLE = np.where(words.LETTERS == 0, 32, words.LETTERS).astype(np.uint8)
CELLS = "lang string, source string, word string, n long, docs long"
CHUNKS = "lang string, words array<string>, sources array<string>, totals array<long>, source array<int>, id array<int>, n array<long>"


def _words(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(place of its text, word) of every word: runs of ASCII letters, put in lower case, and of all that isn't ASCII."""
    at, data = common.utf8(text)
    low, high = int(at[0]), int(at[-1])
    plain = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at - low), pa.py_buffer(_TABLE[data[low:high]]))
    split = pc.split_pattern(plain, " ")
    flat, parent = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(pc.binary_length(flat), 0)
    return parent.filter(full).to_numpy(zero_copy_only=False), common.plain(flat.filter(full)).dictionary_encode()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, word, n, docs): occurrences, and documents with the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", TEXT):
                doc, found = _words(part.column(2))
                if not len(doc):
                    continue
                term, size = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)
                # texts of one (lang, source) are a group; a document's word first, then what groups have of it
                names = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
                keys = {}
                group = np.array([keys.setdefault((r["lang"], r["source"]), len(keys)) for r in names.to_pylist()], np.int64)
                seen, times = np.unique(doc.astype(np.int64) * size + term, return_counts=True)
                cell, where = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
                n = np.bincount(where, weights=times, minlength=len(cell)).astype(np.int64)
                own = list(keys)
                pick = lambda k, c=cell, s=size, o=own: pa.array([x[k] for x in o], pa.string()).take(pa.array(c // s))
                yield pa.RecordBatch.from_arrays([pick(0), pick(1), found.dictionary.take(pa.array(cell % size)).cast(pa.string()), pa.array(n), pa.array(np.bincount(where, minlength=len(cell)))], ["lang", "source", "word", "n", "docs"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    cells = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(count, CELLS)
    return cells.groupBy("lang", "source", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _starts(changed: list[pa.Array]) -> np.ndarray:
    """Where rows begin that differ from the one before in any of the columns."""
    n = len(changed[0])
    new = np.ones(n, bool)
    for c in changed:
        if n > 1:
            same = pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same if c is changed[0] else new[1:] | ~same
    return np.flatnonzero(new)


def chunks(cells: DataFrame, least: int = LEAST) -> DataFrame:
    """The kept words in stretches (see CHUNKS): a sorted array of words, and for each cell the places of its source and word with its count; ``totals`` are sums by source."""

    def stretch(lang: str, table: pa.Table, kept: np.ndarray, word_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``kept`` marks the table's rows, ``word_of`` says which word of the table a row has."""
        for a in range(0, int(word_of[-1]) + 1 if len(word_of) else 0, STRETCH):
            mask = kept & (word_of >= a) & (word_of < a + STRETCH)
            part = table.filter(pa.array(mask))
            if not part.num_rows:
                continue
            dictionary = pc.unique(part["word"]).cast(pa.binary())  # sorted as they come
            array = np.array(dictionary.to_pylist(), object)
            ids = np.searchsorted(array, np.array(part["word"].cast(pa.binary()).to_pylist(), object))
            source = common.plain(part["source"]).dictionary_encode()
            n = part["n"].to_numpy()
            at = source.indices.to_numpy(zero_copy_only=False)
            totals = np.zeros(len(source.dictionary), np.int64)
            np.add.at(totals, at, n)
            row = [[lang], [dictionary.cast(pa.string()).to_pylist()], [source.dictionary.to_pylist()], [totals], [at.astype(np.int32)], [ids.astype(np.int32)], [n]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["lang", "words", "sources", "totals", "source", "id", "n"])

    def encode(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        lang, word = common.plain(table["lang"]), common.plain(table["word"])
        edges = np.append(_starts([lang]), table.num_rows)
        for a, b in zip(edges, edges[1:], strict=False):
            one = table.slice(int(a), int(b - a)).combine_chunks()
            first = np.zeros(one.num_rows, np.int64)
            first[_starts([common.plain(one["word"])])] = 1
            word_of = np.cumsum(first) - 1
            docs = np.bincount(word_of, weights=one["docs"].to_numpy()).astype(np.int64)
            kept = docs[word_of] >= least
            # numbers of kept words only, so that stretches are full
            number = np.cumsum(docs >= least) - 1
            yield from stretch(lang[int(a)].as_py(), one, kept, number[word_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 16 * STRETCH:
                continue
            held = held.combine_chunks()
            # the last word may go on in the next batch
            last = int(_starts([common.plain(held["lang"]), common.plain(held["word"])])[-1])
            if last:
                yield from encode(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from encode(held)

    parts = max(common.partitions_for(cells), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartitionByRange(parts, "lang", "word").sortWithinPartitions("lang", "word").mapInArrow(run, CHUNKS)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exact for any ``whole`` under 2^53: the quotient is worked out three decimal digits at a time."""
    rest, out = count + 1, np.zeros_like(count + whole)
    for _ in range(3):
        step = rest * 1000
        out, rest = out * 1000 + step // whole, step % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compared(encoded: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): what stretches add to pairs of sources, and the words of a stretch that a source has more of than its language, at most ``top`` of each source.

    ``totals`` has a row a language: lang, v (kept words), names (its sources in UTF-8 order), sums (their N).
    """
    fields = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]

    def rows(lang: str, source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(([lang] * len(source), source, [part] * len(source), item, value), fields, strict=True)], [n for n, _ in fields])

    def stretch(r: dict, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, v = r["names"], r["v"]
        sums = np.array(r["sums"], np.int64)
        place = {s: i for i, s in enumerate(names)}
        own = np.array([place[s] for s in r["sources"]], np.int64)[np.array(r["source"], np.int64)]
        ids, n = np.array(r["id"], np.int64), np.array(r["n"], np.int64)
        each = max(1, DENSE // len(names))
        best: dict[int, list[np.ndarray]] = {i: [] for i in range(len(names))}
        for a in range(0, len(r["words"]), each):
            size = min(each, len(r["words"]) - a)
            mine = (ids >= a) & (ids < a + size)
            dense = np.zeros(len(names) * size, np.int64)
            np.add.at(dense, own[mine] * size + ids[mine] - a, n[mine])
            dense = dense.reshape(len(names), size)
            p = shares(dense, (sums + v)[:, None])
            q = shares(dense.sum(0), np.int64(sums.sum() + v))
            for i in range(len(names)):
                pairs[i] += apart(p[i][None, :], p).sum(1)
                more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                best[i].append(np.stack([apart(p[i][more], q[more]), more + a]))
        for i, found in best.items():
            value, word = np.concatenate(found, 1)
            order = np.lexsort((word, -value))[:top]  # ids ascend with UTF-8
            if len(order):
                yield rows(r["lang"], [names[i]] * len(order), "term", [r["words"][w] for w in word[order]], value[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, pairs = None, [], np.zeros((0, 0), np.int64)

        def sums() -> Iterator[pa.RecordBatch]:
            for i, s in enumerate(names):
                others = [j for j in range(len(names)) if j != i]
                if others:
                    yield rows(now, [s] * len(others), "pair", [names[j] for j in others], pairs[i, others])

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["lang"] != now:
                    yield from sums()
                    now, names = r["lang"], r["names"]
                    pairs = np.zeros((len(names), len(names)), np.int64)
                yield from stretch(r, pairs)
        yield from sums()

    # a row a language: its sources' names and sums
    return encoded.join(F.broadcast(totals), "lang").mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in fields))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 for each source and part): ``pair`` for every other source of the language, ``term`` for the ``top`` words that a source has more of than its language."""
    cells = common.stored(counts(docs), "cells")
    encoded = common.stored(chunks(cells, least), "stretches")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    n = encoded.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = encoded.groupBy("lang").agg(F.sum(F.size("words")).alias("v"))
    sums = groups.join(n, ["lang", "source"], "left").fillna(0, ["n"])
    listed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
    totals = common.stored(listed.join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.col("g.source").alias("names"), F.col("g.n").alias("sums")), "totals")
    found = compared(encoded, totals, top)
    wordless = totals.filter("v = 0").select("lang", F.explode("names").alias("source"), "names").select("lang", "source", F.lit("pair").alias("part"), F.explode("names").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").unionByName(wordless.filter("source != item")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # every task has tops of its own: they are cut down in ``SPREAD`` parts of a source before it meets in one
    order = [F.desc("value"), F.col("item")]
    dealt = found.filter("part = 'term'").withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(SPREAD)))
    terms = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part", "deal").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "deal")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE = "1 + (1000000000::BIGINT * ({c} + 1)) // {w}"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM d),
k AS (SELECT lang, word FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST}), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, word, count(*) AS n FROM w JOIN k USING (lang, word) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
s AS (SELECT t.lang, t.source, k.word, coalesce(c.n, 0) AS n, {_SHARE.format(c="coalesce(c.n, 0)", w="(t.total + v.v)")} AS p FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.word = k.word),
l AS (SELECT s.lang, s.word, {_SHARE.format(c="sum(s.n)::BIGINT", w="(any_value(x.total) + any_value(v.v))")} AS q FROM s JOIN (SELECT lang, sum(total)::BIGINT AS total FROM t GROUP BY 1) x USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.word = x.word GROUP BY ALL),
term AS (SELECT s.lang, s.source, s.word AS item, (p - q) * (p - q) // q AS value FROM s JOIN l USING (lang, word) WHERE s.n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= {TOP}
"""
