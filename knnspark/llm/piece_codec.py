"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's words are concatenated and their suffixes sorted; every piece of the vocabulary is found in that order by binary
search, which gives the range of all its occurrences. The occurrences are edges; sorted by position they answer, for two
neighbouring symbols, whether their union is a piece and how early it merges. Relaxation applies, in every word at once, the
earliest merge (the leftmost of equals) until none is left: the library's own order, so the ids are the same. (A least-cost path over the edges would
not give a BPE model's ids.) Characters without a piece fall back to bytes.

No piece but a run of word marks holds a mark after another character, so text falls into words there, and
each distinct word is encoded once in a worker as long as its bounded table holds it.

Edge cases: null and empty texts have no ids; texts of any length are encoded whole; a literal word mark (U+2581) decodes
as a space, as in the library; repeated rows are encoded each; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knnspark.llm.common import prepare

MARK = "▁"
#: Characters a packed word holds; words a worker remembers; characters from which a word is relaxed alone.
PACK, REMEMBERED, LONG = 3, 500_000, 300
_NEVER = np.iinfo(np.int64).max


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        self.bytes_of: list[bytes] = [b""] * len(names)
        self.byte_id = np.zeros(256, np.int64)
        normal = []
        for i in ids:
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(names[i][3:5], 16)])
                self.byte_id[int(names[i][3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = names[i].replace(MARK, " ").encode()
                normal.append(i)
        self.id_of = {names[i]: i for i in normal}
        scores = np.array([model.get_score(i) for i in normal])
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        self.longest = max(map(len, self.id_of))
        self.words = -(-self.longest // PACK)
        self.pieces = sorted(self.id_of)
        self.ids = np.array([self.id_of[p] for p in self.pieces])
        self.lengths = np.array([len(p) for p in self.pieces])
        self.rank = np.array([rank[i] for i in self.ids])
        text = np.zeros((len(self.pieces), self.words * PACK), np.int64)
        for i, p in enumerate(self.pieces):
            text[i, : len(p)] = list(map(ord, p))
        self.packed = pack(text.reshape(len(self.pieces), self.words, PACK))
        self.splits_at_newline = not any("\n" in p for p in self.pieces)
        assert not any(MARK in p.lstrip(MARK) for p in self.pieces), "a piece holds a word mark inside"
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        rule = rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.splits_at_newline else rf"{MARK}*[^{MARK}]+|{MARK}+"
        find = re.compile(rule).findall
        split = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        self.learn(list({w for ws in split for w in ws if w not in known}))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        whole = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return whole.decode("utf-8", "replace")[1:]

    def learn(self, words: list[str], most: int = 400_000) -> None:
        batch, size = [], 0
        for w in words:
            batch.append(w)
            size += len(w)
            if size > most:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)

    def _learn(self, words: list[str]) -> None:
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        first = np.cumsum(lengths + 1) - lengths - 1
        inside = np.ones(len(text), bool)
        inside[first + lengths] = False
        text = np.where(inside, text + 1, 0)  # a separator sorts before any character, even U+0000
        start, length, kind = self.edges(text)
        key = start * 64 + length
        by_position = np.argsort(key, kind="stable")
        key, kind = key[by_position], kind[by_position]
        for w, ids in zip(words, self.relax(words, text, first, lengths, key, kind), strict=True):
            self.known[w] = ids

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence of every piece."""
        order, packed = suffix_array(text, self.words)
        low, high = (self._bound(order, packed, upper) for upper in (False, True))
        many = high - low
        which = np.repeat(np.arange(len(self.pieces)), many)
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))
        return order[at], self.lengths[which], which

    def _bound(self, order: np.ndarray, packed: np.ndarray, upper: bool) -> np.ndarray:
        """For each piece, the first suffix not before it, or the first beyond all that begin with it."""
        low, high = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            less, decided = np.zeros(len(open_), bool), np.zeros(len(open_), bool)
            for d in range(self.words):
                theirs = packed[np.minimum(at + d * PACK, len(packed) - 1)]
                mine = self.packed[open_, d]
                if upper:  # compare no further than the piece goes
                    theirs = theirs & _MASKS[np.clip(self.lengths[open_] - d * PACK, 0, PACK)]
                now = ~decided & (theirs != mine)
                less[now] = theirs[now] < mine[now]
                decided |= now | (mine & _MASKS_LAST == 0)
                if decided.all():
                    break
                ended = ~decided & (theirs & _MASKS_LAST == 0)
                less[ended] = True
                decided |= ended
            if upper:
                same = self._begins(at, packed, open_)
                less |= same
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    def _begins(self, at: np.ndarray, packed: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for d in range(self.words):
            theirs = packed[np.minimum(at + d * PACK, len(packed) - 1)] & _MASKS[np.clip(self.lengths[which] - d * PACK, 0, PACK)]
            need = self.lengths[which] > d * PACK
            out &= ~need | ((theirs == self.packed[which, d]) & (at + d * PACK < len(packed)))
        return out

    def relax(self, words: list[str], text: np.ndarray, first: np.ndarray, lengths: np.ndarray, key: np.ndarray, kind: np.ndarray) -> list[bytes]:
        def lookup(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            """The piece's number, or -1."""
            k = start * 64 + length
            i = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
            return np.where((length <= self.longest) & (key[i] == k), kind[i], -1) if len(key) else np.full(len(k), -1)

        def rank(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            k = lookup(start, length)
            return np.where(k >= 0, self.rank[k], _NEVER)

        short = np.flatnonzero(lengths < LONG)
        word = np.repeat(short, lengths[short])
        begin = np.repeat(first[short] - (np.cumsum(lengths[short]) - lengths[short]), lengths[short]) + np.arange(len(word))
        end = begin + 1
        cost = self._pair(np.arange(len(word)), word, begin, end, rank)
        done: list[tuple[np.ndarray, ...]] = []
        while len(word):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(cost, heads)
            sizes = np.diff(np.append(heads, len(word)))
            live = np.repeat(best < _NEVER, sizes)
            done.append((word[~live], begin[~live], end[~live]))
            if not live.any():
                break
            hit = live & (cost == np.repeat(best, sizes))
            at = np.flatnonzero(hit)
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost in each word
            end[at] = end[at + 1]
            keep = live.copy()
            keep[at + 1] = False
            moved = np.zeros(len(word), bool)
            moved[at] = True
            word, begin, end, cost, moved = word[keep], begin[keep], end[keep], cost[keep], moved[keep]
            at = np.flatnonzero(moved)
            for touched in (at, at[at > 0] - 1):
                cost[touched] = self._pair(touched, word, begin, end, rank)
        if done:
            word, begin, end = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(begin, kind="stable")
            word, begin, end = word[order], begin[order], end[order]
        out: list[bytes] = [b""] * len(words)
        for w in np.flatnonzero(lengths >= LONG).tolist():
            spans = self._relax_one(int(first[w]), int(lengths[w]), lookup)
            out[w] = self._ids(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), text, lookup)[0].tobytes()
        if len(word):
            ids, owner = self._ids(begin, end, text, lookup)
            of = word[owner]
            edges = np.searchsorted(of, np.arange(len(words) + 1))
            flat = ids.tobytes()
            for w, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b > a:
                    out[w] = flat[4 * a : 4 * b]
        return out

    @staticmethod
    def _pair(at: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray, rank) -> np.ndarray:
        out = np.full(len(at), _NEVER)
        ok = at + 1 < len(word)
        ok[ok] = word[at[ok]] == word[at[ok] + 1]
        i = at[ok]
        out[ok] = rank(begin[i], end[i + 1] - begin[i])
        return out

    def _relax_one(self, first: int, length: int, lookup) -> list[tuple[int, int]]:
        """The same for one long word, with a heap of merges."""
        ends = {first + i: first + i + 1 for i in range(length)}
        before = {first + i: first + i - 1 for i in range(1, length)}

        def offer(starts: list[int]) -> None:
            pairs = [(a, ends[a], ends[ends[a]]) for a in starts if ends.get(a) in ends]
            if pairs:
                a, m, b = (np.array(x) for x in zip(*pairs, strict=True))
                k = lookup(a, b - a)
                for i in np.flatnonzero(k >= 0).tolist():
                    heapq.heappush(heap, (int(self.rank[k[i]]), int(a[i]), int(m[i]), int(b[i])))

        heap: list[tuple[int, int, int, int]] = []
        offer(list(ends))
        while heap:
            _, a, m, b = heapq.heappop(heap)
            if ends.get(a) != m or ends.get(m) != b:
                continue
            ends[a] = b
            del ends[m]
            if b in ends:
                before[b] = a
            offer([a] if a == first else [before[a], a])
        return sorted(ends.items())

    def _ids(self, begin: np.ndarray, end: np.ndarray, text: np.ndarray, lookup) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and which symbol each is of: one, or the bytes of a character that has no piece."""
        k = lookup(begin, end - begin)
        ids = np.where(k >= 0, self.ids[k], -1)
        if (k >= 0).all():
            return ids.astype("<u4"), np.arange(len(ids))
        many, spelled = np.ones(len(ids), np.int64), {}
        for i in np.flatnonzero(k < 0).tolist():
            spelled[i] = self.byte_id[list(chr(int(text[begin[i]]) - 1).encode("utf-8"))]
            many[i] = len(spelled[i])
        owner = np.repeat(np.arange(len(ids)), many)
        out, at = ids[owner], np.cumsum(many) - many
        for i, b in spelled.items():
            out[at[i] : at[i] + len(b)] = b
        return out.astype("<u4"), owner


_SHIFTS = np.array([42, 21, 0])
_MASKS = np.array([0, ((1 << 21) - 1) << 42, ((1 << 42) - 1) << 21, (1 << 63) - 1], np.int64)
_MASKS_LAST = np.int64((1 << 21) - 1)


def pack(chars: np.ndarray) -> np.ndarray:
    """The last axis's three characters (plus one, where not zero) as one ordered integer."""
    chars = np.where(chars > 0, chars + 1, 0) if chars.ndim == 3 else chars
    return (chars << _SHIFTS).sum(-1)


def suffix_array(text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text of 0-ended words, sorted by their first 3 * words characters; and the packed text.

    Characters after a word's end don't count; a suffix that has ended is sorted no further.
    """
    padded = np.concatenate([text, np.zeros(PACK, np.int64)])
    n = len(text)
    a, b, c = padded[:n], padded[1 : n + 1].copy(), padded[2 : n + 2].copy()
    b[a == 0] = 0
    c[b == 0] = 0
    packed = (a << 42) | (b << 21) | c
    order = np.flatnonzero(text)
    order = order[np.argsort(packed[order], kind="stable")]
    tied = np.diff(packed[order], prepend=-1) != 0
    group = np.cumsum(tied)
    for d in range(1, words):
        sizes = np.bincount(group)
        more = np.flatnonzero((sizes[group] > 1) & (packed[np.minimum(order + (d - 1) * PACK, n - 1)] & _MASKS_LAST != 0))
        if not len(more):
            break
        at = order[more]
        word = packed[np.minimum(at + d * PACK, n - 1)]
        again = np.lexsort((word, group[more]))
        order[more] = at[again]
        word = word[again]
        g = group[more]
        new = np.ones(len(more), bool)
        new[1:] = (g[1:] != g[:-1]) | (word[1:] != word[:-1])
        fresh = np.zeros(len(order), np.int64)
        fresh[more] = new
        first = np.diff(group, prepend=0) != 0
        group = np.cumsum(first | (fresh > 0))
    return order, packed


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded (read back from the ids), of all whole texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                coded = [np.frombuffer(x, "<u4") for x in v.encode([t or "" for t in b.column(1).to_pylist()])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([v.decode(x) for x in coded], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")

