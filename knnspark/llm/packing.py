"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program takes as few configurations as cover the
histogram. Multiplicative weights solve it: each round prices lengths by their weights, and a bounded knapsack dynamic program finds
for every length the best configuration that holds it; those within `slack` of the best one share the round. Covered
lengths lose weight, and rounds go on until the solution, scaled by its least covered length, is near the bound that the prices prove.
The solution is rounded at random, scaled so that no length is used up before the others and by what is left. The program is
solved again for what is left, until that is a small share; sequences for the rest are filled by the same dynamic program,
with lengths as prices, around the largest length left.

The driver only ever holds the histogram (one count for each length up to the capacity) and the configurations, both
bounded by the capacity and the rounds. Rows then find their place by their rank within their length, counted in salted groups.

Edge cases: null text counts as empty (one end token); repeated rows are packed each; extra columns are ignored;
an empty table gives an empty result; a text of any length is cut, never dropped. A row whose id is null is packed like any other.
"""

from __future__ import annotations

import logging
import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.llm.common import Scratch, prepare

log = logging.getLogger(__name__)


class TokenBytes:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    The file's vocabulary is handed to tiktoken, which gives the same ids (a test compares the two) about nine
    times faster. Texts that hold one of the file's added tokens go to the library itself.
    """

    #: The byte-level pre-tokenizer's pattern, with possessive repeats (fixed value).
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        self.path, self.added = path, [t["content"] for t in spec.get("added_tokens") or ()]
        self.encode_text = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if any(t in text for t in self.added) else self.encode_text(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]


@cache
def encoder(path: str) -> TokenBytes:
    return TokenBytes(path)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; the first takes the remainder."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                cuts = [cut(x + end, capacity) for x in enc.encode(texts)]
                many = np.array([len(c) for c in cuts])
                flat = np.array([x for c in cuts for x in c], np.int64).reshape(-1, 3)
                rows = np.repeat(np.arange(len(b)), many)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)), *[pa.array(flat[:, i]) for i in range(3)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: A configuration: lengths, rising, and how many of each.
Configuration = tuple[tuple[int, int], ...]


class Knapsack:
    """The best value within each capacity, with no more of a length than there are, and what makes it."""

    def __init__(self, value: np.ndarray, most: np.ndarray):
        """value, most: by length; their size is the capacity plus one. Copies of a length are dealt to items of 1, 2, 4, ... copies."""
        cap = len(value) - 1
        items = []
        for length in np.flatnonzero((most > 0) & (value > 0)).tolist():
            many, step = min(int(most[length]), cap // length), 1
            while many:
                n = min(step, many)
                items.append((length, n))
                many, step = many - n, step * 2
        self.length, self.copies = (np.array([x[i] for x in items], np.int64) for i in (0, 1))
        size, worth = self.length * self.copies, value[self.length] * self.copies
        self.best, self.took = np.zeros(cap + 1), np.zeros((len(items), cap + 1), bool)
        for i, (w, v) in enumerate(zip(size.tolist(), worth.tolist(), strict=True)):
            got = self.best[: cap + 1 - w] + v
            better = got > self.best[w:] + 1e-15
            self.took[i, w:] = better
            self.best[w:][better] = got[better]
        self.size = size

    def configurations(self, room: np.ndarray) -> list[dict[int, int]]:
        """What makes the best value within each of these capacities."""
        room, out = room.copy(), [{} for _ in room]
        for i in range(len(self.size) - 1, -1, -1):
            taken = np.flatnonzero(self.took[i, room])
            for k in taken.tolist():
                length = int(self.length[i])
                out[k][length] = out[k].get(length, 0) + int(self.copies[i])
            room[taken] -= self.size[i]
        return out


@dataclass
class Solution:
    shares: dict[Configuration, float]
    bound: float  # no solution takes fewer sequences

    @property
    def value(self) -> float:
        return sum(self.shares.values())


def solve_program(need: np.ndarray, rounds: int = 120, step: float = 0.3, slack: float = 0.01, gap: float = 0.01) -> Solution:
    """Configurations with fractional shares that cover need[l] items of each length l."""
    there, cap = np.flatnonzero(need), len(need) - 1
    log_w, covered, bound, found = np.zeros(cap + 1), np.zeros(cap + 1), 0.0, {}
    log_w[there] = np.log(need[there] * there)  # lengths as prices, at first
    for _ in range(rounds):
        price = np.zeros(cap + 1)
        price[there] = np.exp(log_w[there] - log_w[there].max()) / need[there]
        knapsack = Knapsack(price, need)
        top = knapsack.best[cap]
        bound = max(bound, float((need * price).sum()) / top)
        good = there[price[there] + knapsack.best[cap - there] >= (1 - slack) * top]
        gained, mine = np.zeros(cap + 1), []
        best, *others = knapsack.configurations(np.append(cap, cap - good))
        held_by = [(best, float(min(need[x] // n for x, n in best.items())))]
        for length, held in zip(good.tolist(), others, strict=True):
            if held.get(length, 0) < need[length]:  # the dynamic program has as many of a length as there are already
                held[length] = held.get(length, 0) + 1
                held_by.append((held, float(need[length])))
        for held, share in held_by:
            mine.append((tuple(sorted(held.items())), share))
            for x, n in held.items():
                gained[x] += n * share
        ratio = gained[there] / need[there]
        scale = 1 / ratio.max()
        for c, share in mine:
            found[c] = found.get(c, 0.0) + share * scale
        covered[there] += ratio * scale
        log_w[there] -= step * ratio * scale
        least = covered[there].min()
        if least > 0 and sum(found.values()) / least <= (1 + gap) * bound:
            break
    least = max(covered[there].min(), covered[there].mean() / 2)
    return Solution({c: x / least for c, x in found.items()}, bound)


@dataclass
class Packing:
    plan: list[tuple[Configuration, int]]
    bound: int  # no packing takes fewer sequences
    by_program: int  # items that the program's configurations place

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.plan)


def solve(histogram: np.ndarray, rest: float = 0.08) -> Packing:
    """A plan that holds every item of the histogram exactly once; histogram[l]: items of length l, its size is the capacity plus one.

    rest: the share of items at which the program ends; some of all lengths are needed to fill the last sequences.
    """
    left, cap = histogram.astype(np.int64).copy(), len(histogram) - 1
    plan: dict[Configuration, int] = {}
    by_program, whole = 0, int(left[cap])

    def use(c: Configuration, times: int) -> int:
        for x, n in c:
            times = min(times, int(left[x]) // n)
        if times > 0:
            plan[c] = plan.get(c, 0) + times
            for x, n in c:
                left[x] -= n * times
        return max(times, 0) * sum(n for _, n in c)

    use(((cap, 1),), whole)
    bound, random = whole + -(-int((left * np.arange(cap + 1)).sum()) // cap), np.random.default_rng(11)
    every, turn, spares = int(left.sum()), 0, (0, 1, 2)
    while left.sum() > rest * every:
        items, placed = int(left.sum()), 0
        spare = spares[min(len(spares) - 1, turn)]
        turn += 1
        tight = [(c, x) for c, x in solve_program(left).shares.items() if sum(n * length for length, n in c) >= cap - spare]
        covered = np.zeros(cap + 1)
        for c, share in tight:
            for length, n in c:
                covered[length] += n * share
        theta = 1 / max(1.0, np.quantile((covered / np.maximum(left, 1))[left > 0], 0.9))  # what is left stays about as even as it was
        for k in random.permutation(len(tight)).tolist():
            c, share = tight[k]
            placed += use(c, int(share * theta + random.random()))
        by_program += placed
        if placed * 20 < items and spare == spares[-1]:
            break
    # short items are what fills the last sequences: some go back to them, from the configurations that hold the most items
    back = by_program - int((1 - rest - 0.02) * every)
    for c in sorted(plan, key=lambda c: -sum(n for _, n in c)):
        many = sum(n for _, n in c)
        times = min(plan[c], max(0, back) // many) if c[-1][0] < cap else 0
        if times:
            plan[c], back, by_program = plan[c] - times, back - times * many, by_program - times * many
            for x, n in c:
                left[x] += n * times
    while left.any():
        use(fullest(left), 1 << 62)
    return Packing([(c, times) for c, times in plan.items() if times], bound, by_program)


def fullest(left: np.ndarray) -> Configuration:
    """The largest length left and what fills its sequence best; of equals, long items."""
    cap, top = len(left) - 1, int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[top] -= 1
    lengths = np.arange(cap + 1)
    knapsack = Knapsack((lengths * (1 + lengths * 1e-9))[: cap - top + 1], rest[: cap - top + 1])
    held = knapsack.configurations(np.array([cap - top]))[0]
    held[top] = held.get(top, 0) + 1
    return tuple(sorted(held.items()))


class Places:
    """Where the r-th item of a length goes."""

    def __init__(self, plan: list[tuple[Configuration, int]], cap: int):
        rows, sequence = [], 0  # length, first rank, items a sequence, first sequence, offset of the first
        taken = [0] * (cap + 1)
        for c, times in plan:
            offset = 0
            for length, n in c:
                rows.append((length, taken[length], n, sequence, offset))
                taken[length] += n * times
                offset += n * length
            sequence += times
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.rows = self.rows[np.lexsort((self.rows[:, 1], self.rows[:, 0]))]
        self.start = np.searchsorted(self.rows[:, 0], np.arange(cap + 2))
        self.cap = cap

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for x in np.unique(length):
            here = length == x
            a, b = self.start[x], self.start[x + 1]
            at[here] = a + np.searchsorted(self.rows[a:b, 1], rank[here], "right") - 1
        r = self.rows[at]
        q = rank - r[:, 1]
        return r[:, 3] + q // r[:, 2], r[:, 4] + q % r[:, 2] * length


def pack(parts: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` from 1 to capacity.

    order: columns that identify a row. Ranks are counted within (length, salt) groups; n rows of a length have about
    sqrt(n) salts, so no length, however common, meets in one task.
    """
    prepare(parts.sparkSession)
    count = parts.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in count:
        histogram[r["length"]] = r["count"]
    packing = solve(histogram)
    log.info("packing: %d sequences, bound %d, %d of %d items by the program", packing.sequences, packing.bound, packing.by_program, histogram[:capacity].sum())
    places = Places(packing.plan, capacity)
    salts = F.create_map(*[F.lit(int(x)) for n in np.flatnonzero(histogram) for x in (n, math.isqrt(int(histogram[n]) - 1) + 1)]) if histogram.any() else F.create_map(F.lit(0), F.lit(1))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*order), F.coalesce(salts[F.col("length").cast("int")], F.lit(1))))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    local = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = local.join(before, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_salt", "_before", "_rank")
    ranked = ranked.select(*parts.columns, F.col("rank").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("rank")
            sequence, offset = places.find(b.column("length").to_numpy(zero_copy_only=False), b.column(i).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(i)], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:i], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents with their sequences and offsets."""
    scratch = Scratch(docs.sparkSession)
    parts = scratch.keep(pieces(docs, tokenizer, end_id, capacity, id_col, text_col))
    return pack(parts, capacity, ["doc_id", "piece", "start", "length", "ids_crc32"])
