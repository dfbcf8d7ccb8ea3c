"""Katz backoff scoring of whole texts over word n-grams.

Training documents' n-grams are counted up to `order`; Good-Turing discounts (Katz's form, for counts up to 5) free mass, which each
context hands to words that it was not seen with, in proportion to the next lower order's probability. Backoff weights are
normalised exactly: a context's probabilities over the vocabulary and the unknown word sum to 1. A text's score is the sum over its
tokens, the end included, of the highest order's discounted probability where the n-gram was seen, else the context's weight times the
lower order's, and so on down to the unknown word's mass.

Nothing travels token by token. Documents become blocks (a few MB of text as numbers of a vocabulary of the block's own). For each
order, a block's distinct n-grams go, packed, to tables partitioned by their context's hash; there they are counted, and each
block gets back each n-gram's count and each context's sum and weight, which make the probabilities. The next order starts from these. Contexts that make a thousandth of all tokens or more (a thousand of them at most) are split by the next word, and
their sums added up apart, so that no context is too hot.

Edge cases: null text is empty and has the end token only; a null id counts as the empty string for the split; every row is scored,
repeated rows alike; extra columns are ignored; an empty table gives an empty result; with no training token every token is unknown.
Words are told apart by 64-bit hashes, and so are contexts of two words or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knnspark.llm.common import U64, Scratch, mix, prefix_sums, prepare, slices, span_hash, utf8, words

#: Counts above this are trusted.
TRUSTED = 5
#: Hash of the mark of a text's last token, and the context before its first.
END, BEGIN = mix(np.array([0xE0], U64))[0], U64(0)
_STEP = U64(0x9E3779B97F4A7C15)
#: Bytes of text in a block, and tokens a table partition is made for.
BLOCK_BYTES, PART_TOKENS = 8_000_000, 1_000_000


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pack(x: np.ndarray) -> bytes:
    """Integers take as many bytes as the largest needs, few distinct floats become places in their list; bytes of equal weight lie together."""
    head, body = b"", x
    if x.dtype.kind == "f":
        values, place = np.unique(x, return_inverse=True)
        if len(values) * 2 < len(x):
            head, body = values.tobytes(), place
    if body.dtype.kind in "iu" and len(body):
        body = body.astype(np.min_scalar_type(int(body.max())) if int(body.min()) >= 0 else body.dtype)
    planes = body.view(np.uint8).reshape(len(body), -1).T.tobytes() if len(body) else b""
    meta = np.array([len(head), len(body)], "<i8").tobytes() + x.dtype.str.encode().ljust(4) + body.dtype.str.encode().ljust(4)
    return zstandard.compress(meta + head + planes, 3)


def unpack(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    head, n = np.frombuffer(data[:16], "<i8").tolist()
    kind, stored = (np.dtype(data[a : a + 4].decode().strip()) for a in (16, 20))
    planes = np.frombuffer(data, np.uint8, offset=24 + head)
    body = np.ascontiguousarray(planes.reshape(-1, n).T).view(stored).ravel() if n else np.zeros(0, stored)
    return np.frombuffer(data[24 : 24 + head], kind)[body] if head else body.astype(kind)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """The factor for each count from 0 to TRUSTED; where Good-Turing has no sound value, half a count goes."""
    n = [counts_of_counts.get(r, 0) for r in range(TRUSTED + 2)]
    big = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 0.0
    out = [1.0]
    for r in range(1, TRUSTED + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - big) / (1 - big) if n[r] and big < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(r: np.ndarray, d: list[float]) -> np.ndarray:
    return r * np.append(d, 1.0)[np.minimum(r, TRUSTED + 1)]


def by_pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places in rising order of context, then word."""
    if len(word) and int(context.max()) < 1 << 32 and int(word.max()) < 1 << 32:
        return np.argsort((context << U64(32)) | word, kind="stable")
    return np.lexsort((word, context))


def distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair, in rising order, stands first; and each row's pair."""
    by = by_pair(context, word)
    c, w = context[by], word[by]
    new = np.ones(len(by), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of


def blocks(rows: DataFrame, kind: str) -> DataFrame:
    """block, ids, held_out, ends, vocabulary, tokens; rows: doc_id, held_out, text. ends: tokens up to each document's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 33, [], 0

        def whole() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            ends = np.cumsum(np.concatenate([h[3] for h in held]))
            ids = pa.concat_arrays([h[0] for h in held])
            out = pa.concat_arrays([h[1] for h in held]).to_numpy(zero_copy_only=False)
            cols = [pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            cols += [pa.array([x], pa.binary()) for x in (pack(out.astype(np.uint8)), pack(steps(ends)), vocabulary.tobytes(), pack(tokens.astype(np.int64)))]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "held_out", "ends", "vocabulary", "tokens"])

        for b in batches:
            buf, offsets = utf8(b.column("text"))
            for i, j in slices(offsets):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, e, first = words(part, at)
                h = np.insert(span_hash(prefix_sums(part, lower=True), a, e), first[1:], END)
                held.append((b.column("doc_id").slice(i, j - i), b.column("held_out").slice(i, j - i), h, np.diff(first) + 1))
                size += len(part) + j - i
                if size >= BLOCK_BYTES:
                    yield whole()
                    made, held, size = made + 1, [], 0
        if held:
            yield whole()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, held_out binary, ends binary, vocabulary binary, tokens binary")


class Block:
    """One row of the blocks' table. low: the probability of each token under the order before."""

    def __init__(self, row: dict):
        self.ends = np.cumsum(unpack(row["ends"]))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.held_out = unpack(row["held_out"]).astype(bool)
        self.vocabulary = np.frombuffer(row["vocabulary"], U64)
        self.local = unpack(row["tokens"])
        self.train = np.repeat(~self.held_out, self.ends - self.starts)
        for name in ("number", "count", "low"):
            setattr(self, name, unpack(row[name]) if row.get(name) else None)

    def payload(self, order: int) -> np.ndarray:
        """What an n-gram's table needs to know the lower order's probability of each token: of a word, its count."""
        return self.low if order > 2 else self.count[self.local] if order == 2 else np.zeros(len(self.local), np.int64)

    def contexts(self, order: int) -> np.ndarray:
        """A key for the order - 1 tokens before each token; fewer at a text's start."""
        out = np.zeros(len(self.local), U64)
        for m in range(2, order + 1):
            before = self.number[self.local[:-1]].astype(U64)
            out[1:] = following(out[:-1], before) if m > 2 else before + U64(1)
            out[self.starts] = BEGIN
        return out

    def grams(self, order: int, parts: int, hot: np.ndarray) -> tuple:
        """Distinct (context, word) pairs by partition: their partitions, contexts, words, first tokens; and each token's pair."""
        word = self.number[self.local].astype(U64) if order > 1 else self.vocabulary[self.local]
        context = self.contexts(order)
        first, of = distinct(context, word)
        c, w = context[first], word[first]
        part = mix(np.where(np.isin(c, hot), c + mix(w), c) + _STEP) % U64(parts) if order > 1 else w % U64(parts)
        part = part.astype(np.int32)
        by = np.argsort(part, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return part[by], c[by], w[by], first[by], place[of]

    def dealt(self, order: int, parts: int, hot: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        part, context, word, first, of = self.grams(order, parts, hot)
        n = np.bincount(of, self.train, len(first)).astype(np.int64)
        low = self.payload(order)[first]
        edges = np.flatnonzero(np.append(np.append(True, part[1:] != part[:-1]), True)) if len(part) else []
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(part[a]), pack(steps(context[a:b])), pack(word[a:b]), pack(n[a:b]), pack(low[a:b])


def following(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context + _STEP) + word)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True) if n != "ids"} | ({"ids": b.column("ids").slice(i, 1)} if "ids" in b.schema.names else {})


def _out(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    names = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])


DEALT = "part int, block long, contexts binary, words binary, n binary, low binary"
TABLE = "part int, contexts binary, words binary, r binary, low binary, blocks array<long>, places array<binary>, kinds long, total long, often array<long>"


def _deal(order: int, parts: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        yield _out(DEALT, [(part, row["block"], *packed) for part, *packed in Block(row).dealt(order, parts, hot)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each partition: its distinct n-grams by context, and where each block's are among them."""

    def one(held: list[dict]) -> pa.RecordBatch:
        context = np.concatenate([np.cumsum(unpack(h["contexts"]), dtype=U64) for h in held])
        word, low = (np.concatenate([unpack(h[c]) for h in held]) for c in ("words", "low"))
        each = [unpack(h["n"]) for h in held]
        n = np.concatenate(each)
        first, of = distinct(context, word)
        r = np.bincount(of, n, len(first)).astype(np.int64)
        ends = np.cumsum([len(x) for x in each])[:-1]
        places = [pack(steps(x)) for x in np.split(of, ends)]
        often = np.bincount(np.minimum(r, TRUSTED + 2), minlength=TRUSTED + 3)[: TRUSTED + 2]
        return _out(TABLE, [(held[0]["part"], pack(steps(context[first])), pack(word[first]), pack(r), pack(low[first]), [h["block"] for h in held], places, int((r > 0).sum()), int(r.sum()), often.tolist())])

    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0]["part"] != row["part"]:
            yield one(held)
            held = []
        held.append(row)
    if held:
        yield one(held)


class Table:
    """One order's n-grams, partitioned by their context's hash."""

    def __init__(self, blocks_: DataFrame, order: int, parts: int, hot: np.ndarray, scratch: Scratch):
        self.order, self.parts, self.hot = order, parts, hot
        dealt = blocks_.mapInArrow(partial(_deal, order, parts, hot), DEALT)
        self.rows = scratch.keep(dealt.repartition("part").sortWithinPartitions("part", "block").mapInArrow(_count, TABLE))
        sums = [F.sum(F.col("often")[i]).alias(f"n{i}") for i in range(TRUSTED + 2)]
        got = self.rows.agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"), *sums).first()
        self.kinds, self.total = got["kinds"] or 0, got["total"] or 0
        self.discounts = discounts({i: got[f"n{i}"] or 0 for i in range(1, TRUSTED + 2)})

    def kept(self) -> float:
        """The whole discounted count."""

        def run(d: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                yield _out("kept double", [(float(discounted(unpack(row["r"]), d).sum()),)])

        return self.rows.select("r").mapInArrow(partial(run, self.discounts), "kept double").agg(F.sum("kept")).first()[0] or 0.0

    def common(self, least: float) -> np.ndarray:
        """Contexts of the next order that were seen `least` times or more: total / least of them at most."""
        order, parts = self.order, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                context, word, r = np.cumsum(unpack(row["contexts"]), dtype=U64), unpack(row["words"]), unpack(row["r"])
                number = np.arange(len(r), dtype=np.int64) * parts + row["part"]
                key = number.astype(U64) + U64(1) if order == 1 else following(context, word)
                yield _out("key long", [(int(x),) for x in key[r >= max(1.0, least)].view(np.int64)])

        got = self.rows.select("part", "contexts", "words", "r").mapInArrow(run, "key long").collect()
        return np.append(np.array([r["key"] for r in got], np.int64).view(U64), BEGIN)

    def numbers(self) -> DataFrame:
        """block, part, number, count: each word's number, which no other word has, and its count. For order 1."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                r, out = unpack(row["r"]), []
                for block, packed in zip(row["blocks"], row["places"], strict=True):
                    at = np.cumsum(unpack(packed))
                    out.append((block, row["part"], pack(steps(at * parts + row["part"])), pack(r[at])))
                yield _out("block long, part int, number binary, count binary", out)

        return self.rows.select("part", "r", "blocks", "places").mapInArrow(run, "block long, part int, number binary, count binary")

    def values(self, lower: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """lower: probabilities from payloads. block, part, r, below, weight: each n-gram's count; of each of its contexts, the denominator, and the weight where it has unseen ones."""
        hot, d, schema = self.hot, self.discounts, "block long, part int, r binary, below binary, weight binary"

        def sums(row: dict) -> tuple:
            context, r, low = np.cumsum(unpack(row["contexts"]), dtype=U64), unpack(row["r"]), lower(unpack(row["low"]))
            start = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            seen = r > 0
            add = lambda x: np.add.reduceat(np.where(seen, x, 0.0), start)
            return context, start, r, add(r), add(discounted(r, d)), add(low)

        def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                context, start, _, c, kept, low = sums(row)
                mine = np.isin(context[start], hot)
                yield _out("context long, c double, kept double, low double", list(zip(context[start][mine].view(np.int64).tolist(), c[mine].tolist(), kept[mine].tolist(), low[mine].tolist(), strict=True)))

        rows = self.rows.select("part", "contexts", "r", "low", "blocks", "places")
        got = rows.drop("blocks", "places").mapInArrow(partial_sums, "context long, c double, kept double, low double")
        whole = {int(np.int64(x["context"]).view(U64)): tuple(x)[1:] for x in got.groupBy("context").agg(F.sum("c"), F.sum("kept"), F.sum("low")).collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                context, start, r, c, kept, low = sums(row)
                for i in np.flatnonzero(np.isin(context[start], hot)):
                    c[i], kept[i], low[i] = whole[int(context[start[i]])]
                below = np.where(kept < c, c, c + 1)
                weight = np.where(c > 0, (1 - kept / below) / np.maximum(1 - low, 1e-15), 1.0)
                of, out = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context)))), []
                for block, packed in zip(row["blocks"], row["places"], strict=True):
                    at = np.cumsum(unpack(packed))
                    mine, group = np.unique(of[at], return_inverse=True)
                    unseen = np.bincount(group, r[at] == 0) > 0
                    out.append((block, row["part"], pack(r[at]), pack(below[mine].astype(np.int64)), pack(np.where(unseen, weight[mine], 0.0))))
                yield _out(schema, out)

        return rows.mapInArrow(run, schema)


def _with(blocks_: DataFrame, back: DataFrame) -> DataFrame:
    """Each block with what its n-grams got, by partition: as much as the block has n-grams."""
    cols = [c for c in back.columns if c != "block"]
    return blocks_.join(back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("back")), "block")


def score_texts(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from rows not held out."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    now = scratch.keep(blocks(rows, kind), "none")
    size = now.agg(F.sum(F.length("vocabulary"))).first()[0] or 0
    parts = max(32, size // (8 * PART_TOKENS // 4))
    words_ = Table(now, 1, parts, np.zeros(0, U64), scratch)
    tokens, types, d1 = words_.total, words_.kinds, words_.discounts
    kept = words_.kept()
    whole = tokens if kept < tokens else tokens + 1
    unknown = 1 - kept / whole  # the mass of all unknown words together

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            part, _, _, first, _ = block.grams(1, parts, np.zeros(0, U64))
            at = block.local[first]  # places in the block's vocabulary, in the order in which they were dealt
            number, count = np.zeros(len(block.vocabulary), np.int64), np.zeros(len(block.vocabulary), np.int64)
            number[at] = np.concatenate([np.cumsum(unpack(x["number"])) for x in row["back"]])
            count[at] = np.concatenate([unpack(x["count"]) for x in row["back"]])
            yield numbered_out(row, number=pack(number), count=pack(count))

    def numbered_out(row: dict, **more: bytes) -> pa.RecordBatch:
        row = row | {"vocabulary": row["vocabulary"] if order < 2 else b"", "low": row.get("low", b"")} | more
        return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), row["ids"], *[pa.array([row[n]], pa.binary()) for n in NUMBERED[2:]]], names=NUMBERED)

    def single(count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, d1) / whole, unknown)

    def scored(block: Block, ids: pa.Array, p: np.ndarray) -> pa.RecordBatch:
        c = block.count[block.local]
        base = np.log10((block.count + 0.1) / (tokens + 0.1 * (types + 1)))[block.local]
        add = lambda x: np.add.reduceat(x, block.starts)
        n = pa.array(block.ends - block.starts)
        cols = [ids.flatten(), pa.array(block.held_out), n, pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(n), tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"block long, ids array<{kind}>, " + ", ".join(f"{n} binary" for n in NUMBERED[2:])
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    then = scratch.keep(_with(now, words_.numbers()).mapInArrow(numbered, schema), "none")
    scratch.drop(now)
    now, table = then, words_
    for m in range(2, order + 1):
        hot = table.common(tokens / 1000)
        scratch.drop(table.rows)
        grams = max(32, tokens // PART_TOKENS)
        table = Table(now, m, grams, hot, scratch)

        def lifted(batches: Iterator[pa.RecordBatch], m: int = m, grams: int = grams, hot: np.ndarray = hot, d: list[float] = table.discounts) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                block = Block(row)
                part, context, _, _, of = block.grams(m, grams, hot)
                group = np.cumsum(np.append(False, (part[1:] != part[:-1]) | (context[1:] != context[:-1])))
                r, below, weight = (np.concatenate([unpack(x[c]) for x in row["back"]]) for c in ("r", "below", "weight"))
                seen, own, weight = (r > 0)[of], (discounted(r, d) / below[group])[of], weight[group][of]
                p = np.where(seen, own, weight * (block.low if m > 2 else single(block.count)[block.local]))
                yield scored(block, row["ids"], p) if m == order else numbered_out(row, low=pack(p))

        back = _with(now, table.values(single if m == 2 else np.asarray))
        if m == order:
            return back.mapInArrow(lifted, result)
        then = scratch.keep(back.mapInArrow(lifted, schema), "none")
        scratch.drop(now)
        now = then

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            yield scored(block, row["ids"], single(block.count)[block.local])

    return now.mapInArrow(singles, result)


NUMBERED = ["block", "ids", "held_out", "ends", "vocabulary", "tokens", "number", "count", "low"]
