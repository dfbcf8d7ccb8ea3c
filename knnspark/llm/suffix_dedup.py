"""Removal of repeated byte strings by sparse suffix sorting (deep-shallow).

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every such window is dealt to
its anchor: its smallest hashed k-gram, the leftmost of equals. Equal windows have equal anchors at equal offsets, so
only anchors with equal k-grams need comparing, and no window is compared twice. An anchor carries its segment, the union
of its windows. Segments that are equal as a whole are counted, not compared. The others' suffixes (from
the anchor on) and reversed prefixes are sorted: multikey quicksort, eight bytes a step, to a shallow depth, then blind
tries for groups whose common prefix is longer. The common prefixes of both orders give, for each pair, the offsets at
which their windows agree.

Groups with more than `dense` segments are split by offset ranges: windows at offsets lo to hi all hold the bytes from
anchor - lo to anchor + length - hi, which makes the finer group key; members that agree on all of a range are counted and one lives on. A range of one offset leaves
one member, so every group ends, however hot.

Edge cases: null text is empty; texts shorter than `length` stay whole; matches never cross rows; repeated rows repeat
each other and lose all their windows; rows are told apart by a 64-bit hash of id and text; extra columns are ignored.
Segments count as equal if both 64-bit hashes (k-gram and segment) are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knnspark.llm.common import U64, Scratch, mix, prefix_sums, prepare, slices, span_hash, utf8

GRAM = 32


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: block-wise running minima from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """row, key, segment hash, segment start (in the row), segment length, anchor - start for all anchors."""
    n = len(buf)
    nothing = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return nothing
    h = prefix_sums(buf)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(h, at, at + GRAM)
    least = sliding_least((grams & U64(0xFFFFFFFF00000000)) | at.astype(U64), length - GRAM + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.arange(len(least)) + length <= end[: len(least)]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return nothing
    anchor = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a = starts[first], starts[last] + length, anchor[first]
    row = np.searchsorted(offsets, lo, "right") - 1
    segment = span_hash(h, lo, hi) ^ mix((a - lo).astype(U64))
    return row, grams[a].view(np.int64), segment.view(np.int64), lo - offsets[row], hi - lo, a - lo


def deep_shallow(texts: list[bytes], shallow: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of `texts`, and each one's common prefix with the one before it."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(t[:shallow].ljust(shallow, b"\0") for t in texts), ">u8").reshape(n, shallow // 8)
    order, tied = np.arange(n), np.zeros(n, np.int64)  # tied: the group of the sorted position
    for depth in range(shallow // 8):
        _, sizes = np.unique(tied, return_counts=True)
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            break
        word = flat[order, depth]
        again = np.lexsort((word, tied))
        order, word, tied = order[again], word[again], tied[again]
        fresh = np.ones(n, bool)
        fresh[1:] = (word[1:] != word[:-1]) | (tied[1:] != tied[:-1])
        tied = np.cumsum(fresh)
    common = np.zeros(n, np.int64)
    edges = np.append(np.flatnonzero(np.diff(tied, prepend=-1)), n)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            group = order[a:b].tolist()
            ordered, lcp = blind_trie([texts[i] for i in group])
            order[a:b] = [group[i] for i in ordered]
            common[a + 1 : b] = lcp[1:]
    x, y = flat[order[1:]], flat[order[:-1]]
    apart = x != y
    k = np.where(apart.any(1), apart.argmax(1), shallow // 8)
    heads = np.flatnonzero((tied[1:] != tied[:-1]) if n > 1 else np.zeros(0, bool))
    for i in heads.tolist():
        j = int(k[i])
        d = int(x[i, j] ^ y[i, j]) if j < shallow // 8 else 0
        common[i + 1] = min(8 * j + (8 - (d.bit_length() + 7) // 8 if d else 8), lengths[order[i]], lengths[order[i + 1]])
    return order, common


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


def blind_trie(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorts strings by a trie that keeps, at each branch, only its depth and next bytes.

    A string is sent down blindly, by the bytes at branch depths; one comparison with the leaf that it meets gives its
    true common prefix, and with it the edge to split. Leaves are read in byte order; the depth of the branch where
    two neighbours part is their common prefix. A string's end sorts before any byte.
    """
    root: list = [len(texts[0]), {-1: [0]}]  # a branch: depth, children; leaves: lists of equal strings' numbers
    for k in range(1, len(texts)):
        t = texts[k]
        node, path = root, [root]
        while isinstance(node[1] if len(node) > 1 else None, dict):
            depth, children = node
            b = t[depth] if depth < len(t) else -1
            node = children.get(b) or next(iter(children.values()))
            path.append(node)
        lcp = common_prefix(t, texts[node[0]])
        if lcp == len(t) == len(texts[node[0]]):
            node.append(k) if not (len(node) > 1 and isinstance(node[1], dict)) else None
            continue
        above = None
        for node in path:
            if not (len(node) > 1 and isinstance(node[1], dict)) or node[0] >= lcp:
                break
            above = node
        b = t[lcp] if lcp < len(t) else -1
        if len(node) > 1 and isinstance(node[1], dict) and node[0] == lcp:
            node[1][b] = [k]
            continue
        old = texts[_leaf(node)]
        branch = [lcp, {(old[lcp] if lcp < len(old) else -1): node, b: [k]}]
        if above is None:
            root = branch
        else:
            c = t[above[0]] if above[0] < len(t) else -1
            above[1][c] = branch
    order: list[int] = []
    common: list[int] = []

    def read(node: list, depth: int) -> None:
        if not (len(node) > 1 and isinstance(node[1], dict)):
            for i, k in enumerate(node):
                common.append(depth if i == 0 else len(texts[k]))
                order.append(k)
            return
        for i, b in enumerate(sorted(node[1])):
            read(node[1][b], depth if i == 0 else node[0])

    read(root, 0)
    return order, common


def _leaf(node: list) -> int:
    while len(node) > 1 and isinstance(node[1], dict):
        node = next(iter(node[1].values()))
    return node[0]


def agreeing(group: list[int], right: dict, left: dict, length: int, lo: int, hi: int) -> dict[int, list[tuple[int, int]]]:
    """For members of a group, the offset ranges at which another member has the same window.

    right, left: (place in sorted order, common prefix with the one before) of each member.
    """
    n = len(group)
    out: dict[int, list[tuple[int, int]]] = {}
    r_order, l_order = (sorted(range(n), key=lambda i: side[group[i]][0]) for side in (right, left))
    r_common, l_common = ([side[group[i]][1] for i in order] for side, order in ((right, r_order), (left, l_order)))
    if n == 2:
        a, b = max(lo, length - r_common[1]), min(hi, l_common[1])
        return {g: [(a, b)] for g in group} if a <= b else {}
    first, last = max(lo, length - max(r_common[1:])), min(hi, max(l_common[1:]))
    if first > last:
        return {}
    offsets = np.arange(first, last + 1)
    kind = np.zeros((n, len(offsets)), np.int64)
    for order, common, need in ((r_order, r_common, length - offsets), (l_order, l_common, offsets)):
        apart = np.array(common)[:, None] < need[None, :]
        apart[0] = True
        kind[order] = kind[order] * (n + 1) + np.cumsum(apart, axis=0)
    by = np.argsort(kind, axis=0, kind="stable")
    ordered = np.take_along_axis(kind, by, axis=0)
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros((n, len(offsets)), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = np.zeros_like(twice)
    np.put_along_axis(found, by, twice, axis=0)
    for i in np.flatnonzero(found.any(1)):
        runs = np.flatnonzero(np.diff(np.concatenate([[0], found[i].astype(np.int8), [0]])))
        out[group[i]] = [(int(offsets[a]), int(offsets[b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]
    return out


def _compare(length: int):
    def solve(rows: list[tuple]) -> list[tuple[int, int, int]]:
        right_order, right_common = deep_shallow([r[7][r[3] :] for r in rows])
        left_order, left_common = deep_shallow([r[7][: r[3]][::-1] for r in rows])
        right = dict(zip(right_order.tolist(), zip(range(len(rows)), right_common.tolist(), strict=True), strict=True))
        left = dict(zip(left_order.tolist(), zip(range(len(rows)), left_common.tolist(), strict=True), strict=True))
        sides = [_within(rows, s) for s in (right, left)]
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            if j - i > 1:
                for k, ranges in agreeing(list(range(i, j)), *sides, length, rows[i][5], rows[i][6]).items():
                    if rows[k][4] == 1:
                        at = rows[k][2] + rows[k][3]
                        out += [(rows[k][1], at - b, at - a + length) for a, b in ranges]
            i = j
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= 4000 and held[-1][0] != row[0]:
                    yield _spans(solve(held))
                    held = []
                held.append(row)
        if held:
            yield _spans(solve(held))

    return run


def _within(rows: list[tuple], side: dict) -> dict:
    """Common prefixes between neighbours of the same group: the least of those passed over in the whole order."""
    out, last = {}, {}
    ordered = sorted(side, key=lambda i: side[i][0])
    # neighbours of one group are close in the order; a sparse table answers the least between two places
    levels = [np.array([side[i][1] for i in ordered])]
    while 2 ** len(levels) <= len(ordered):
        p, s = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(p[:-s], p[s:]))
    for place, i in enumerate(ordered):
        g = rows[i][0]
        if g in last:
            a, b = last[g] + 1, place + 1
            k = (b - a).bit_length() - 1
            out[i] = (place, int(min(levels[k][a], levels[k][b - 2**k])))
        else:
            out[i] = (place, 0)
        last[g] = place
    return out


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a = np.array(found, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2])], names=["rk", "a", "b"])


def _split(length: int):
    """Two offset ranges for each member: finer key, hash of what the range's windows hold, and that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gk", "rk", "s", "left", "c", "lo", "hi", "seg", "rel"]
        for b in batches:
            out = []
            for gk, rk, s, left, c, lo, hi, seg in zip(*(x.to_pylist() for x in b.columns), strict=True):
                mid = (lo + hi) // 2
                for low, high in ((lo, mid), (mid + 1, hi)):
                    x, y = max(low, left + length - len(seg)), min(high, left)  # offsets of the windows it has
                    if x > y:
                        continue
                    part = seg[left - y : left - x + length]
                    shared = seg[left - low : left + length - high]  # in every window of the range
                    key = hashlib.blake2b(shared, digest_size=8, key=f"{gk},{low}".encode()).digest()
                    rel = hashlib.blake2b(part, digest_size=16, key=f"{x},{y}".encode()).digest()
                    out.append((int.from_bytes(key, "little", signed=True), rk, s + left - y, y, c, low, high, part, rel))
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 200, dense: int = 256) -> DataFrame:
    """rk, a, b: byte ranges (they may overlap) to remove from rows rk, text."""
    prepare(docs.sparkSession)
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x[1])], names=["key"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x[1]), pa.array(x[2]), ids.take(pa.array(x[0])), pa.array(x[3]), pa.array(x[4].astype(np.int32)), pa.array(x[5].astype(np.int32))], names=["key", "ch", "rk", "s", "n", "left"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            buf, offsets = utf8(b.column("text"))
            for i, j in slices(offsets):
                x = anchors(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                if len(x[0]):
                    yield b.column("rk").slice(i, j - i), x

    # what is joined lies in a table first, so that Spark can split a hot key's rows in the join
    shared = scratch.keep(docs.select("text").withColumn("rk", F.lit(0).cast("long")).mapInArrow(keys, "key long").groupBy("key").count().filter("count > 1").select("key"))
    every = scratch.keep(docs.select("rk", "text").mapInArrow(rows, "key long, ch long, rk long, s long, n int, left int").join(shared, "key", "left_semi"))
    first = F.min(F.struct("rk", "s", "n", "left"))
    classes = scratch.keep(every.groupBy("key", "ch").agg(F.count(F.lit(1)).alias("c"), first.alias("r")))
    copies = every.join(classes.filter("c > 1").select("key", "ch"), ["key", "ch"], "left_semi").select("rk", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c")).filter("k > 1 AND c = 1").select("key")
    wanted = classes.join(mixed, "key", "left_semi").groupBy(F.col("r.rk").alias("rk")).agg(F.collect_list(F.struct("key", "c", F.col("r.s").alias("s"), F.col("r.n").alias("n"), F.col("r.left").alias("left"))).alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                out = []
                b = whole.slice(at, 200)
                for rk, text, w in zip(b.column("rk").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("w").to_pylist(), strict=True):
                    out += [(x["key"], rk, x["s"], x["left"], x["c"], 0, length - GRAM, text[x["s"] : x["s"] + x["n"]]) for x in w]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["gk", "rk", "s", "left", "c", "lo", "hi", "seg"])

    columns = ["gk", "rk", "s", "left", "c", "lo", "hi", "seg"]
    kinds = "gk long, rk long, s long, left int, c long, lo int, hi int, seg binary"
    distinct = docs.select("rk", "text").join(wanted, "rk")
    members = scratch.keep(distinct.mapInArrow(cut, kinds).dropDuplicates(["gk", "rk", "s"]))
    parts = [copies]
    while True:
        sizes = scratch.keep(members.groupBy("gk").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("least")).filter("size > 1 AND least = 1").select("gk", "size"))
        sized = members.join(sizes, "gk")
        small = sized.filter(F.col("size") <= dense).select(*columns).repartition("gk").sortWithinPartitions("gk")
        parts.append(scratch.keep(small.mapInArrow(_compare(length), "rk long, a long, b long")))
        large = sized.filter(F.col("size") > dense).select(*columns)
        if large.isEmpty():
            break
        halves = scratch.keep(large.mapInArrow(_split(length), f"{kinds}, rel binary"))
        same = scratch.keep(halves.groupBy("gk", "rel").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("rk", "s")).alias("one")))
        halves = halves.join(same, ["gk", "rel"])
        parts.append(scratch.keep(halves.filter("k > 1 AND c = 1").select("rk", F.col("s").alias("a"), (F.col("s") + F.length("seg")).alias("b"))))
        members = scratch.keep(halves.filter("rk = one.rk AND s = one.s").withColumn("c", F.greatest("c", "k")).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = 200, dense: int = 256, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns `carry`, removed (sorted, maximal byte ranges a, b), kept (the remaining bytes), kept_text
    (the same without characters that a cut has split) and n_bytes of every row."""
    scratch = Scratch(docs.sparkSession)
    more = [F.col(c) for c in carry or []]
    own = F.struct(F.col(id_col).alias("doc_id"), *more).alias("own")
    keyed = docs.select(own, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("rk"))
    spans = repeated_spans(keyed, scratch, length, dense)
    by_row = spans.distinct().groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                removed, kept, sizes = [], [], []
                for text, ranges in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist(), strict=True):
                    gone = merged(ranges or [])
                    edges = [0, *(x for r in gone for x in r), len(text)]
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"a": x, "b": y} for x, y in gone])
                    sizes.append(len(text))
                texts = [x.decode("utf-8", "ignore") for x in kept]
                yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["own", "removed", "kept", "kept_text", "n_bytes"])

    kind = keyed.schema["own"].dataType.simpleString()
    out = keyed.join(by_row, "rk", "left").select("own", "text", "ranges").mapInArrow(apply, f"own {kind}, removed array<struct<a:long,b:long>>, kept binary, kept_text string, n_bytes long")
    return out.select("own.*", "removed", "kept", "kept_text", "n_bytes")
