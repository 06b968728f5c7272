"""Near duplicates by BagMinHash (operator 10).

A text is the multiset of its five-word shingles; words are runs of letters and digits, whatever their case. Each shingle carries Poisson processes over its weight axis, cut in the
dyadic intervals [0,1), [1,2), [2,4), [4,8) ...: the points of an interval have times, a component and a height, all given by hashes, and a point counts
for a text if its height is below the shingle's count there. A component of the signature is the first counting time. Two texts agree
in a component with a probability of exactly their weighted Jaccard similarity. Bands of ``ROWS`` components are hashed to buckets; texts that
share a bucket are candidates, and the exact overlap of their multisets verifies them: twice what they share over what both hold, ``LEAST`` or more (0.8 is a weighted Jaccard similarity of 2/3).

Copies are collapsed first, and only different texts are compared. First every bucket compares its members with one pivot, the text with the most copies, which settles most buckets. In a
bucket whose members are still of several classes, those outside its largest class are compared with all others: links within a class would join nothing. Its members are dealt by hash to
blocks of about ``BLOCK`` texts or ``BLOCK_BYTES``, each pair of blocks is one group, and a product of its shingle matrices gives all its similarities at once. So a bucket of n texts with k
outsiders sends n texts for each block of outsiders, whatever n is, and no task gets a bucket whole. There is no cap: all pairs of different classes that share a bucket are compared. A group
sends out only links that join classes, fewer than it has texts.

Defined cases: null text is empty; texts without words are copies of each other only if they are alike byte for byte; a text of one to four words is one shingle;
a null doc_id gets its class like any other; the class id is the least doc_id of the class, null if it has none; an empty table gives no rows; rows that share doc_id and text are one class;
a text of any length is taken whole, its shingles in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import roots
from .words import WORDS as LETTERS_AND_DIGITS
from .words import word_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 4096
SIZE = BANDS * ROWS
#: Distinct shingles whose processes run at once.
RUN = 1 << 20
_MULTIPLIERS = common.mix64(np.arange(301, 301 + WORDS)) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of all five-word shingles, in order."""
    h, ends = word_hashes(data, at, LETTERS_AND_DIGITS)
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    rows = np.concatenate([row, np.full(WORDS, -1)])
    for k in range(WORDS):  # words beyond the text add nothing
        total += np.where(rows[k : k + len(h)] == row, padded[k : k + len(h)] * _MULTIPLIERS[k], np.uint64(0))
    place = np.arange(len(h)) - ends[row] if len(h) else np.zeros(0, np.int64)
    keep = place < np.maximum(n[row] - WORDS + 1, 1) if len(h) else np.zeros(0, bool)
    return common.mix64(total[keep]), row[keep]


def _keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return common.mix64(h ^ (row.astype(np.uint64) * _GOLD))


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, count) of the distinct shingles of each text."""
    h, row = shingles(data, at)
    if not len(h):
        return h, row, np.zeros(0, np.int64)
    key = _keys(h, row)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return h[order][first], row[order][first], np.diff(np.append(first, len(h)))


def _processes(times: np.ndarray, size: int, until: np.ndarray, shingle: np.ndarray, row: np.ndarray, count: np.ndarray) -> None:
    """Lowers ``times`` by the points, up to each text's ``until``, of the processes of these shingles."""
    # intervals: level 0 is [0, 1), level k is [2**(k-1), 2**k)
    levels = np.zeros(len(count), np.int64)
    levels[count > 1] = np.ceil(np.log2(count[count > 1])).astype(np.int64)
    of = np.repeat(np.arange(len(count)), levels + 1)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    l = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    w = np.where(level == 0, 1, l)
    s = common.mix64(shingle[of] + level.astype(np.uint64) * _GOLD)
    o, t = row[of], count[of]
    x, j = np.zeros(len(s)), 0
    while len(s):
        j += 1
        r = common.mix64(s + np.uint64(j * 0xD1342543DE82EF95 & (1 << 64) - 1))
        x = x - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        go = x <= until[o]
        s, w, l, o, t, x, r = s[go], w[go], l[go], o[go], t[go], x[go], r[go]
        r = common.mix64(r ^ _GOLD)
        counts = l + ((r >> np.uint64(32)) % w.astype(np.uint64)).astype(np.int64) < t
        part = ((r & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(times, o[counts] * size + part[counts], x[counts])


def signatures(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` first times of each text; infinite for a text without shingles."""
    texts = len(at) - 1
    shingle, row, count = bags(data, at)
    weight = np.bincount(row, weights=count, minlength=texts)
    times = np.full(texts * size, np.inf)
    wanted = np.flatnonzero(weight > 0)
    until = np.zeros(texts)
    until[wanted] = size / weight[wanted] * (np.log(size) + 4)
    while len(wanted):
        live = np.flatnonzero(np.isin(row, wanted, kind="table")) if len(wanted) < texts else np.arange(len(row))
        for k in range(0, len(live), RUN):
            i = live[k : k + RUN]
            _processes(times, size, until, shingle[i], row[i], count[i])
        wanted = wanted[~np.isfinite(times.reshape(texts, size)[wanted]).all(1)]
        until[wanted] *= 2
    return times.reshape(texts, size)


def band_keys(times: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = common.mix64(np.ascontiguousarray(times).view(np.uint64)).reshape(len(times), BANDS, ROWS)
    keys = np.zeros((len(times), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = common.mix64(keys * _GOLD + bits[:, :, k])
    return keys.view(np.int64)


def overlaps(texts: list[bytes]) -> np.ndarray:
    """The overlap of texts 0 and 1, 2 and 3, and so on: twice the shared multiset over both; 1 where neither has a word."""
    pairs = len(texts) // 2
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    shingle, row, count = bags(np.frombuffer(b"".join(texts), np.uint8), ends)
    total = np.bincount(row // 2, weights=count, minlength=pairs)
    key = _keys(shingle, row // 2)
    order = np.argsort(key)
    key, row, count = key[order], row[order], count[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    shared = np.bincount(row[same] // 2, weights=np.minimum(count[same], count[same + 1]), minlength=pairs)
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


def similarity(a: str, b: str) -> float:
    """The exact multiset overlap of two texts."""
    return float(overlaps([a.encode(), b.encode()])[0])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, size, bands) of each row: no text leaves its task. Copies within a batch are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                at, data = common.utf8(part.column(2))
                raw = data.tobytes() if len(at) == 1 else data[at[0] : at[-1]].tobytes()
                digest = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                place: dict[bytes, int] = {}
                own = [place.setdefault(x, len(place)) for x in digest]
                first = np.unique(own, return_index=True)[1]
                pick = np.concatenate([data[at[i] : at[i + 1]] for i in first])
                keys = band_keys(t := signatures(pick, np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[first])])))
                none = ~np.isfinite(t[:, 0])
                rows = [None if none[i] else keys[i] for i in own]
                columns = [part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array(rows, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "digest", "size", "bands"])

    return _own(docs).mapInArrow(run, "doc_id long, key long, digest binary, size long, bands array<long>")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), common.text_or_empty().alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (u, v) whose texts, from ``texts`` (node, text), are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "a", 2 << 20):
                both = [x.as_py().encode() for pair in zip(part.column(2), part.column(3), strict=True) for x in pair]
                yield part.select(["u", "v"]).filter(pa.array(overlaps(both) >= least, pa.bool_()))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def joining_links(texts: list[str], roots_: list[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar texts that join classes: with them and the classes given by ``roots_``, all similar texts are connected. Exact, over all pairs.

    Texts outside the largest class meet all others. What they share comes from products of the matrix texts x shingles, a stretch of shingles at a time; a shingle that comes k times in a
    text is k columns.
    """
    raw = [t.encode() for t in texts]
    shingle, row, count = bags(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    n, size = len(texts), np.bincount(row, weights=count, minlength=len(texts))
    class_ = np.unique(roots_, return_inverse=True)[1]
    rest = np.flatnonzero(class_ != np.bincount(class_).argmax())
    token, row = np.repeat(shingle, count), np.repeat(row, count)
    token = common.mix64(token + (np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64) * _GOLD)
    which, at, times = np.unique(token, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # of the shingles that two texts share
    keep = times[at] > 1
    column, row = place[at[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(rest), n))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        both += m[rest] @ m.T
    near = (2 * both >= least * (size[rest, None] + size[None]) - 1e-6) & (both > 0) & (class_[rest, None] != class_[None])
    up = {r: r for r in roots_}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for p, q in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        p = int(rest[p])
        x, y = find(roots_[p]), find(roots_[q])
        if x != y:
            up[x] = y
            out.append((p, q))
    return out


def _compare(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    node, root = table["node"].to_pylist(), table["root"].to_pylist()
    links = joining_links(table["text"].to_pylist(), root) if len(set(root)) > 1 else []
    return pa.table([pa.array([node[j] for _, j in links], pa.int64()), pa.array([node[i] for i, _ in links], pa.int64())], ["u", "v"])


def compared(members: DataFrame, texts: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (u, v) that join classes, from all pairs of different classes within each bucket of ``members`` (bucket, node, size, root).

    Buckets are summed up by class with partial aggregation, so a bucket with a third of all rows is a row a task and class; what is joined to its members is one row.
    """
    per = members.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    open_ = per.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("c", "root", "s")).alias("main"), F.sum("c").alias("n"), F.sum("s").alias("bytes")).filter("classes > 1")
    parts = lambda n, s: F.ceil(F.greatest(n / block, s / block_bytes)).cast("int")
    open_ = open_.select("bucket", F.col("main.root").alias("main"), parts(F.col("n"), F.col("bytes")).alias("all"), parts(F.col("main.c"), F.col("main.s")).alias("nm"), parts(F.col("n") - F.col("main.c"), F.col("bytes") - F.col("main.s")).alias("nr"))
    open_ = common.stored(open_, "open-buckets")
    rows = common.joined(members.select("bucket", "node", "root"), open_, "bucket")
    share = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    m, r = share(F.col("nm")), share(F.col("nr"))
    outside = F.concat(F.transform(upto("nm"), lambda i: group(1, i, r)), F.transform(upto("nr"), lambda i: group(2, F.least(i, r), F.greatest(i, r))))
    groups = F.when(F.col("all") == 1, F.array(group(0, F.lit(0), F.lit(0)))).when(F.col("root") == F.col("main"), F.transform(upto("nr"), lambda i: group(1, m, i))).otherwise(outside)
    dealt = rows.select("bucket", "node", "root", F.inline(groups))
    return dealt.join(texts, "node").groupBy("bucket", "kind", "lo", "hi").applyInArrow(lambda t: _compare(t), "u long, v long")


def _different_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, node ...) of the buckets with several texts, and n, how many; without buckets that hold the same texts as another: a group of near copies meets in most bands.

    Sets are told apart by their size and two 64-bit sums of hashes.
    """
    total = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(20,0)"))
    sets = rows.groupBy("bucket").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).filter("n > 1")
    kept = common.stored(sets.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "different-buckets")
    return rows.join(kept, "bucket").select(*rows.columns, "n")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, key, class_id, class_key): a row for each of ``docs``; the class is named by its least doc_id, and class_key is that row's key."""
    spark = docs.sparkSession
    begun = common.mark(spark)
    rows = common.stored(signed(docs), "signatures")
    held = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("low"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = common.stored(held.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = common.stored(_different_buckets(nodes.select("node", "copies", "size", F.explode("bands").alias("bucket"))), "members")
    # whole texts of the candidates, and of no others
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("low.doc_id").alias("id"), F.col("low.key").alias("k")), "node")
    source = _own(docs)
    texts = source.join(wanted, source["doc_id"].eqNullSafe(F.col("id")) & (source["key"] == F.col("k"))).select("node", "text")
    texts = common.stored(texts.dropDuplicates(["node"]) if _repeated(rows) else texts, "candidate-texts")
    pivots = common.stored(members.groupBy("bucket").agg(F.max(F.struct("copies", F.xxhash64("node").alias("h"), "node")).alias("pivot")).select("bucket", F.col("pivot.node").alias("pivot")), "pivots")
    pairs = members.join(pivots, "bucket").filter("node <> pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
    links = common.stored(verified(pairs, texts, least), "links")
    root = None if links.isEmpty() else roots(links)

    def with_roots(df: DataFrame) -> DataFrame:
        if root is None:
            return df.withColumn("root", F.col("node"))
        return df.join(root.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))

    more = common.stored(compared(common.stored(with_roots(members.filter("n > 2").select("bucket", "node", "size")), "members-with-roots"), texts), "links")
    if not more.isEmpty():
        root = roots(more if root is None else root.unionByName(more))
    of = with_roots(nodes)
    low = F.min(F.when(F.col("low.doc_id").isNotNull(), F.col("low"))).alias("low")
    of = of.select("digest", "root", F.struct(F.col("least_id").alias("doc_id"), F.col("low.key").alias("key")).alias("low"))
    # a text in no class with another names itself
    names = of.groupBy("root").agg(F.count("*").alias("n"), low, F.min("low").alias("any")).filter("n > 1").select("root", F.coalesce("low", "any").alias("name"))
    named = common.joined(of, common.stored(names, "names"), "root", "left").withColumn("name", F.coalesce("name", "low"))
    named = common.stored(named.select("digest", F.col("name.doc_id").alias("class_id"), F.col("name.key").alias("class_key")), "classes")
    common.release(spark, begun, (rows, named))
    return rows.select("doc_id", "key", "digest").join(named, "digest").drop("digest")


def _repeated(rows: DataFrame) -> bool:
    """Whether any doc_id and text comes twice."""
    return not rows.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each class: the one with the least doc_id (then the least hash of its text). Columns of any name are carried through."""
    found = classes(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    own = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("id"), common.row_key().alias("key"))
    out = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    if _repeated(found):
        out = out.dropDuplicates(["id", "key"])
    return common.unpacked(out)


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")
