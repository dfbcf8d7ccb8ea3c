"""Set-similarity self-join on word shingles, by multiple-global-order filtering.

Two documents link when percent * |union| <= 100 * |intersection|. Under any total order of all shingles, sets that
similar share one of their first few (prefix) shingles, and l of a prefix that is l - 1 longer. Two orders are used, both
rarest first by a count sketch, with ties by different hashes: candidates share a prefix shingle under the first and enough
of a longer prefix under the second (16-bit hashes of it travel, not the sets). Candidates that hang together are one
cluster, so that each whole set moves once, and a cluster of up to `direct` members is compared exactly, in memory.

A larger cluster is never compared pair by pair. All its members are compared with one of them, the pivot, which then is
done; the others go on as their differences from it, D. Pairs that both link with the pivot are joined already. If y does
not, and x and y link, then |Dx & Dy| > (|Dx| + r (|p| - |x|)) / 2 with r = (1 - t) / (1 + t), and always
|Dx & Dy| >= |Dx| - |x| (1 - t) / t: the differences have short prefixes of their own, under orders that count within clusters,
and fall into smaller clusters in the same way. Each round costs what its members' differences take, and no link that
joins components is lost. Links between members that are joined already are not listed.

Exact copies are one member. Edge cases: null or wordless text has an empty set and links with nothing; fewer words than a
shingle are one shingle; a null id is a document of its own; ids may be of any type; rows that share an id are one document with
the links of each; extra columns are ignored; empty tables give empty results. Shingles are compared by 64-bit hashes, whole sets
by 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knnspark.llm.common import U64, Scratch, mix, prefix_sums, prepare, slices, span_hash, utf8, words
from knnspark.llm.components import components

#: Buckets of the count sketch, whatever the corpus (4 MB): it only orders shingles, and any order gives the same links.
BITS, PART = 22, 16
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_ORDERS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    a, b, first = words(buf, offsets)
    hashes = span_hash(prefix_sums(buf, lower=True), a, b)
    n = len(hashes)
    joined = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        joined += hashes[j : j + len(joined)] * _STEP[j]
    joined = mix(joined)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= k:
            out.append(np.unique(joined[i : j - k + 1]))
        elif j > i:
            out.append(mix((hashes[i:j] * np.array(_STEP[: j - i])).sum(keepdims=True) + U64(j - i)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(s: np.ndarray) -> bytes:
    return np.array([s.sum(), mix(s + _STEP[0]).sum()], U64).tobytes()


@dataclass
class Orders:
    """counts: of each sketch bucket, from 128 on as a logarithm; tokens of rare buckets come first."""

    counts: np.ndarray
    percent: int

    def first(self, tokens: np.ndarray, length: int, order: int) -> np.ndarray:
        count = self.counts[(tokens >> U64(64 - BITS)).astype(np.int64)].astype(U64)
        key = (count << U64(40)) | (mix(tokens ^ _ORDERS[order]) >> U64(24))
        return tokens[np.argsort(key, kind="stable")[:length]]

    def prefix(self, tokens: np.ndarray, need: int, order: int) -> np.ndarray:
        """Sets that share `need` tokens with this one share one of these."""
        return self.first(tokens, len(tokens) - need + 1, order) if need <= len(tokens) else tokens[:0]

    def wide(self, tokens: np.ndarray, need: int) -> np.ndarray:
        """The second order's prefix, lengthened by as many tokens again (`need` at most), as 16-bit halves."""
        plain = len(tokens) - need + 1
        return np.sort(self.first(tokens, plain - 1 + min(plain, need), 1).astype(np.uint16)) if plain > 0 else np.zeros(0, np.uint16)

    def least(self, n: int) -> int:
        """What a set of n shares with any that links with it."""
        return -(-self.percent * n // 100)

    def least_apart(self, n: int, differ: int) -> int:
        """What its difference from a pivot shares with that of any that links with it."""
        return max(1, differ - n * (100 - self.percent) // self.percent)

    def least_half(self, n: int, pivot: int, differ: int) -> int:
        """The same, with any that links with it but not with the pivot."""
        whole = 100 + self.percent
        return (differ * whole + (100 - self.percent) * (pivot - n)) // (2 * whole) + 1

    def shared(self, n: int, m: int, size: int, size2: int) -> int:
        """How many tokens two sets (or differences) of these sizes share, at least, if the sets of n and m shingles link."""
        whole = 100 + self.percent
        return -(-((size + size2) * whole - (100 - self.percent) * (n + m)) // (2 * whole))

    def links(self, n: int, m: int, differ: int) -> bool:
        """|x| + |y| >= |x xor y| (1+t)/(1-t), in integers."""
        return (100 - self.percent) * (n + m) >= (100 + self.percent) * differ


def _keyed(tokens: np.ndarray, cluster: int) -> np.ndarray:
    """Tokens of a cluster's differences, told apart from those of others; cluster 0 is the whole corpus."""
    return mix(tokens ^ U64(cluster & (2**64 - 1))) if cluster else tokens


def _sets_of(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    buf, offsets = utf8(b.column("text"))
    for i, j in slices(offsets):
        yield i, j, shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def _texts(k: int) -> Callable:
    def run(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for _, _, sets in _sets_of(b, k):
            yield sets

    return run


def _differences(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    yield [_keyed(np.frombuffer(d, U64), ch) for d, ch in zip(b.column("d").to_pylist(), b.column("ch").to_pylist(), strict=True)]


def sketch(rows: DataFrame, tokens: Callable) -> np.ndarray:
    """How many sets hold the tokens of each bucket, over all rows. Tasks send packed parts of their counts."""
    parts, width = 1 << (BITS - PART), 1 << PART

    def packed(total: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int32)
        for b in batches:
            for sets in tokens(b):
                at, n = np.unique((np.concatenate(sets) >> U64(64 - BITS)).astype(np.int64), return_counts=True)
                total[at] += n.astype(np.int32)
        for part in range(parts):
            mine = total[part * width : (part + 1) * width]
            if mine.any():
                yield packed(mine, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(zlib.decompress(data), "<i8")
        for part, total in totals.items():
            yield packed(total, part)

    schema = "part int, counts binary"
    got = rows.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros(1 << BITS, np.uint8)
    for r in got:
        n = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        out[r["part"] * width : (r["part"] + 1) * width] = np.where(n < 128, n, np.minimum(255, 128 + 4 * np.log2(np.maximum(n, 128) / 128)))
    return out


def _hashes(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    yield [b.column("h").to_numpy().view(U64)]


def held(rows: DataFrame, *key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of whether rows may hold a key, by the key's xxhash64 and one bit a bucket: what it lets pass still has to be joined, but
    most texts of others needn't move for that. Its size doesn't grow; with far more keys than buckets it lets all pass."""
    there = np.packbits(sketch(rows.select(F.xxhash64(*key).alias("h")), _hashes) > 0)

    def test(h: np.ndarray) -> np.ndarray:
        at = (h.view(U64) >> U64(64 - BITS)).astype(np.int64)
        return (there[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

    return test


def may_hold(rows: DataFrame, *key: str) -> Callable[..., Column]:
    """`held` as a function of columns. It takes a Python worker of its own in each task."""
    of = held(rows, *key)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(of(h.to_numpy()))

    return lambda *columns: test(F.xxhash64(*columns))


@dataclass
class Join:
    members: DataFrame  # doc_id, n_shingles, id (of the class of equal sets; null if the set is empty)
    classes: DataFrame  # id, rep: each class's smallest doc_id
    links: DataFrame  # a, b: classes whose sets link


def _narrow(key: str, ids: pa.Array, rows: list[tuple[int, int, int, bool, np.ndarray, np.ndarray, int]], **more: pa.Array) -> pa.RecordBatch:
    """rows: n, size, need, apart, prefix, wide, half of each id."""
    at = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32)
    flat = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, U64)
    prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
    cols = {key: ids, **{name: pa.array([r[i] for r in rows], pa.int32()) for i, name in enumerate(("n", "size", "need"))}}
    cols |= {"apart": pa.array([r[3] for r in rows], pa.bool_()), "prefix": prefix, "wide": pa.array([r[5].tobytes() for r in rows], pa.binary()), "half": pa.array([r[6] for r in rows], pa.int32()), **more}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


PAIRS = "a long, b long"
NARROW = "n int, size int, need int, apart boolean, prefix array<long>, wide binary, half int"


def join(docs: DataFrame, scratch: Scratch, k: int = 3, percent: int = 90, dense: int = 1000, direct: int = 250, id_col: str = "doc_id", text_col: str = "text") -> Join:
    """dense: members of a list that the second order filters in memory; direct: members of a cluster that are compared in memory."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    orders = Orders(sketch(docs, _texts(k)), percent)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in _sets_of(b, k):
                rows = []
                for s in sets:
                    need = orders.least(len(s))
                    first = orders.prefix(s, need, 0) if len(s) else s
                    rows.append((len(s), len(s), need, True, first, orders.wide(s, need) if len(s) else np.zeros(0, np.uint16), len(first)))
                yield _narrow("doc_id", b.column(0).slice(i, j - i), rows, sig=pa.array([signature(s) if len(s) else None for s in sets], pa.binary()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = scratch.keep(docs.mapInArrow(summarise, f"doc_id {kind}, {NARROW}, sig binary"))
    parts = ["n", "size", "need", "apart", "prefix", "wide", "half"]
    equal = each.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first(F.struct(*parts)).alias("of"))
    classes = scratch.keep(equal.select(F.monotonically_increasing_id().alias("id"), "sig", "rep", "of.*"))  # numbers are fixed once written
    keys = classes.select("id", "sig", "rep")
    of = F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")
    members = scratch.keep(each.select("doc_id", F.col("n").cast("long").alias("n_shingles"), of).join(keys.select("id", "sig"), "sig", "left").select("doc_id", "n_shingles", "id"))
    scratch.drop(each)
    clusters = _clusters(classes.select("id", *parts), orders, dense, scratch)

    wanted = scratch.keep(keys.join(clusters, "id"))
    of_wanted = held(wanted, "rep")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(of_wanted(b.column("h").to_numpy())))
            for _, _, sets in _sets_of(b, k):
                sets = [s for s in sets if len(s)]
                cols = [pa.array([signature(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([orders.least(len(s)) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["sig", "n", "need", "d"])

    texts = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(whole_sets, "sig binary, n int, need int, d binary")
    first = wanted.join(texts, "sig").groupBy("sig").agg(*[F.first(c).alias(c) for c in ("id", "c", "m", "known", "n", "need", "d")]).drop("sig")
    rows = first.select("*", F.col("id").alias("label"), F.lit(0).cast("long").alias("ch"))
    found = []
    while True:
        rows = scratch.keep(rows)
        small = rows.filter(F.col("m") <= direct).select("c", "id", "label", "n", "need", "ch", "d").repartition("c").sortWithinPartitions("c", "id")
        found.append(scratch.keep(small.mapInArrow(_compare(orders), PAIRS)))
        large = rows.filter(F.col("m") > direct)
        if large.isEmpty():
            scratch.drop(rows)
            break
        centre = large.groupBy("c").agg(F.min_by("id", F.struct(-F.col("known"), "id")).alias("p"))
        pivots = scratch.keep(large.join(centre.withColumnRenamed("c", "of"), F.col("id") == F.col("p")).select("c", "p", F.col("n").alias("pn"), F.col("label").alias("p_label"), F.col("d").alias("pd")))
        against = large.select("c", "id", "n", "label", "d").join(pivots, "c").filter("id <> p").withColumn("ch", F.xxhash64("c"))
        step = scratch.keep(against.select("id", "n", "label", "p", "pn", "p_label", "ch", "d", "pd").mapInArrow(_differ(orders), "id long, n int, label long, p long, pn int, apart boolean, ch long, d binary"))
        found.append(scratch.keep(step.filter("NOT apart").select(F.col("id").alias("a"), F.col("p").alias("b"))))
        scratch.drop(rows, pivots)
        orders = Orders(sketch(step, _differences), percent)
        narrow = scratch.keep(step.mapInArrow(_parts(orders), f"id long, {NARROW}, label long, ch long, d binary"))
        scratch.drop(step)
        clusters = _clusters(narrow, orders, dense, scratch)
        rows = clusters.join(narrow.select("id", "n", "label", "need", "ch", "d"), "id")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return Join(members, keys.select("id", "rep"), links.distinct())


def _clusters(narrow: DataFrame, orders: Orders, dense: int, scratch: Scratch) -> DataFrame:
    """id, c, m, known: members of each cluster, its size, and how much of a member's prefix others share (the pivot has most)."""
    labels = ["label"] if "label" in narrow.columns else []  # none yet: each member is its own
    label = F.col(*labels) if labels else F.col("id").alias("label")
    if labels:  # a pair has a member that is apart from the pivot; two such meet in their shorter prefixes
        ones = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        tokens = narrow.select("apart", "half", F.posexplode("prefix").alias("at", "t"))
        of = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("m"), ones(F.col("apart")).alias("far"), ones(F.col("apart") & (F.col("at") < F.col("half"))).alias("far_half"))
        shared = of.filter("m > 1 AND (far_half > 1 OR (far > 0 AND far < m))").select("t", "m")
    else:
        shared = narrow.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    entries = narrow.select("id", "n", *labels, F.explode("prefix").alias("t"))
    rows = scratch.keep(entries.join(scratch.keep(shared), "t").select("t", "id", "n", label, "m"))
    by_size = Window.partitionBy("t").orderBy("n", "id")
    gap = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * orders.percent, F.lit(True))
    runs = rows.filter(F.col("m") <= dense).withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(by_size))
    runs = runs.select(F.xxhash64("t", "run").alias("t"), "id", "label")
    lists = scratch.keep(runs.unionByName(rows.filter(F.col("m") > dense).select("t", "id", "label")))
    sums = lists.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("of"), F.min("id").alias("head"), F.max("id").alias("tail"), F.min("label").alias("l1"), F.max("label").alias("l2"))
    kept = scratch.keep(sums.filter("m > 1 AND l1 < l2").groupBy("m", "of", "head", "tail").agg(F.min("t").alias("t")).select("t", "m", "head"))
    listed = scratch.keep(lists.select("t", "id").join(kept, "t"))
    small = listed.filter(F.col("m") <= dense).select("t", "id").join(narrow.select("id", label, "n", "size", "wide"), "id").select("t", "id", "label", "n", "size", "wide")
    near = small.repartition("t").sortWithinPartitions("t", "id").mapInArrow(_filter(orders), PAIRS)
    crowded = listed.filter(F.col("m") > dense).select(F.col("id").alias("a"), F.col("head").alias("b"))
    merged = scratch.keep(components(scratch.keep(near.unionByName(crowded)), scratch))
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    known = rows.groupBy("id").agg(F.count(F.lit(1)).alias("known"))
    of = narrow.select("id", F.size("prefix").alias("prefix")).join(known, "id").select("id", (F.col("known") / F.col("prefix")).alias("known"))
    out = scratch.keep(merged.join(scratch.keep(sizes), "component").select(F.col("node").alias("id"), F.col("component").alias("c"), "m").join(of, "id"))
    scratch.drop(rows, lists, listed, merged)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each t, which is the first column; batches are sorted by it."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs_out(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joined(find: Callable) -> Callable:
    """Runs find(group), which yields pairs of a list's or cluster's rows that are to be joined; ids come second in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches):
            for i, j in find(group):
                a.append(group[i][1])
                b.append(group[j][1])
            if len(a) > 10_000:
                yield _pairs_out(a, b)
                a, b = [], []
        yield _pairs_out(a, b)

    return run


def _filter(orders: Orders) -> Callable:
    """Joins members of a list (t, id, label, n, size, wide) that share enough of the second order's prefixes."""

    def small(group: list[tuple]) -> Iterator[tuple[int, int]]:
        halves = [set(np.frombuffer(r[5], np.uint16).tolist()) for r in group]
        width = [len(r[5]) // 2 for r in group]
        root = list(range(len(group)))
        for i, (_, _, label, n, size, _) in enumerate(group):
            for j in range(i):
                _, _, label2, m, size2, _ = group[j]
                if label == label2 or _root(root, i) == _root(root, j):
                    continue
                most = orders.shared(n, m, size, size2)
                need = min(width[i] - size + most, width[j] - size2 + most, most)
                lost = width[i] - len(halves[i]) + width[j] - len(halves[j])  # halves may collide
                if most <= min(size, size2) and len(halves[i] & halves[j]) >= need - lost:
                    root[_root(root, i)] = _root(root, j)
                    yield i, j

    def large(group: list[tuple]) -> Iterator[tuple[int, int]]:
        halves = [np.unique(np.frombuffer(r[5], np.uint16)) for r in group]
        count = np.array([len(h) for h in halves])
        flat = np.concatenate(halves)
        values, place, often = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.flatnonzero(often > 1)
        column = np.full(len(values), -1)
        column[common] = np.arange(len(common))
        who, where = np.repeat(np.arange(len(group)), count), column[place]
        has = np.zeros((len(group), len(common)), np.float32)
        has[who[where >= 0], where[where >= 0]] = 1
        n, size = (np.array([r[c] for r in group], np.int64) for c in (3, 4))
        width = np.array([len(r[5]) // 2 for r in group])
        label = np.array([r[2] for r in group])
        lost, root, whole = width - count, list(range(len(group))), 100 + orders.percent
        for at in range(0, len(group), 256):
            i = np.arange(at, min(at + 256, len(group)))[:, None]
            most = -((-((size[i] + size) * whole - (100 - orders.percent) * (n[i] + n))) // (2 * whole))
            need = np.minimum(np.minimum(width[i] - size[i], width - size) + most, most) - lost[i] - lost
            ok = (has[at : at + 256] @ has.T >= need) & (most <= np.minimum(size[i], size)) & (label[i] != label) & (np.arange(len(group)) < i)
            for x, y in zip(*np.nonzero(ok), strict=True):
                if _root(root, x + at) != _root(root, y):
                    root[_root(root, x + at)] = _root(root, y)
                    yield int(x + at), int(y)

    return _joined(lambda group: small(group) if len(group) <= 40 else large(group))


def _compare(orders: Orders) -> Callable:
    """Links in a cluster (c, id, label, n, need, ch, d): pairs that share a prefix token under both orders are compared exactly."""

    def find(group: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(r[6], U64) for r in group]
        prefixes = [[orders.prefix(_keyed(s, r[5]), r[4], o).tolist() for s, r in zip(sets, group, strict=True)] for o in (0, 1)]
        second = [set(p) for p in prefixes[1]]
        holders: dict[int, list[int]] = {}
        root: list[int] = list(range(len(group)))
        heads: dict = {}
        for i, r in enumerate(group):  # what is joined already has one root
            root[i] = heads.setdefault(r[2], i)
        for i, (_, _, _, n, _, _, _) in enumerate(group):
            x = sets[i]
            for j in sorted({j for t in prefixes[0][i] for j in holders.get(t, ())}):
                m, y = group[j][3], sets[j]
                if _root(root, i) == _root(root, j) or second[i].isdisjoint(second[j]) or orders.shared(n, m, len(x), len(y)) > min(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if orders.links(n, m, len(x) + len(y) - 2 * both):
                    root[_root(root, i)] = _root(root, j)
                    yield i, j
            for t in prefixes[0][i]:
                holders.setdefault(t, []).append(i)

    return _joined(find)


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def _differ(orders: Orders) -> Callable:
    """Differences from the pivot; who links with it takes its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                apart, diffs = [], []
                for n, d, pn, pd in zip(*(b.column(c).to_pylist() for c in ("n", "d", "pn", "pd")), strict=True):
                    diff = np.setxor1d(np.frombuffer(d, U64), np.frombuffer(pd, U64), assume_unique=True)
                    apart.append(not orders.links(n, pn, len(diff)))
                    diffs.append(diff.tobytes())
                far = pa.array(apart, pa.bool_())
                label = pc.if_else(far, b.column("label"), b.column("p_label"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), label, b.column("p"), b.column("pn"), far, b.column("ch"), pa.array(diffs, pa.binary())], names=["id", "n", "label", "p", "pn", "apart", "ch", "d"])

    return run


def _parts(orders: Orders) -> Callable:
    """Prefixes of differences. Who links with the pivot needs the short one only, as it matters to those that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, pn, apart, ch, d in zip(*(b.column(c).to_pylist() for c in ("n", "pn", "apart", "ch", "d")), strict=True):
                tokens = _keyed(np.frombuffer(d, U64), ch)
                need = orders.least_apart(n, len(tokens))
                short = max(need, orders.least_half(n, pn, len(tokens)))
                need = need if apart else short
                first = orders.prefix(tokens, need, 0)
                rows.append((n, len(tokens), need, apart, first, orders.wide(tokens, need), max(0, len(tokens) - short + 1)))
            yield _narrow("id", b.column("id"), rows, **{c: b.column(c) for c in ("label", "ch", "d")})

    return run


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90, dense: int = 1000, direct: int = 250, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, the document's own included)."""
    scratch = Scratch(docs.sparkSession)
    found = join(docs, scratch, k, percent, dense, direct, id_col, text_col)
    several = found.members.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b < last").select("doc_id", "b")
    same = found.members.join(scratch.keep(several), "doc_id").select(F.col("id").alias("a"), "b").filter("a IS NOT NULL")
    heads = scratch.keep(components(found.links.unionByName(same), scratch))
    least = heads.join(found.classes, heads.node == found.classes.id).groupBy("component").agg(F.min("rep").alias("least"))
    of = found.classes.join(heads.join(least, "component").select(F.col("node").alias("id"), "least"), "id", "left").select("id", F.coalesce("least", "rep").alias("component_id"))
    return found.members.join(of, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
