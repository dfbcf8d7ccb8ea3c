"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 takes for listed
although they aren't; level 2 the listed keys that level 1 takes for such; and so on until a level
has no false positive. As the levels are checked against every key that occurs in the corpus,
membership is exact there and needs no join: the cascade is a few bits a listed key.

A key is a host suffix with a path prefix. Edge cases: a null url, or one without ``://``, has an
empty host and path and fits no rule; empty tables give empty results; repeated rows are judged each;
further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnspark.llm.common import mix, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host`, its subdomains, and paths that begin with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with the path's prefixes of these lengths (a rule's path has one of them)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    both = F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, path.substr(F.lit(1), n))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(both))


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int  # levels must not repeat each other's false positives
    data: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, pairs: np.ndarray, rate: float, seed: int) -> Level:
        bits = max(64, math.ceil(len(pairs) * math.log(1 / rate) / math.log(2) ** 2))
        hashes = max(1, round(math.log2(1 / rate)))
        out = cls(bits, hashes, seed, np.zeros((bits + 7) // 8, np.uint8))
        for at in out.places(pairs):
            np.bitwise_or.at(out.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def places(self, pairs: np.ndarray) -> Iterator[np.ndarray]:
        first, step = (mix(pairs[:, i] + np.uint64((2 * self.seed + i) * 0x9E3779B97F4A7C15 % 2**64)) for i in (0, 1))
        for i in range(self.hashes):
            yield (first + np.uint64(i) * (step | np.uint64(1))) % np.uint64(self.bits)

    def has(self, pairs: np.ndarray) -> np.ndarray:
        out = np.ones(len(pairs), bool)
        for at in self.places(pairs):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Exact over the universe that it was built against."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, pairs: np.ndarray) -> np.ndarray:
        """A key that passes levels 0 to k-1 and fails level k is listed if k is odd."""
        out, left = np.zeros(len(pairs), bool), np.arange(len(pairs))
        for k, level in enumerate(self.levels):
            passed = level.has(pairs[left])
            out[left[~passed]] = k % 2 == 1
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1
        return out


def hashed(keys: DataFrame) -> DataFrame:
    """A key's two 64-bit hashes; levels derive theirs from these."""
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def build_cascade(universe: DataFrame, listed: list[str], growth: float = 8.0) -> Cascade:
    """The cascade for `listed` over the distinct `key`s of `universe`.

    The driver gets false positives only, about as many as listed keys: level 0's rate follows the
    sizes of both sets. A level is refused where they exceed `growth` times the listed keys (and 1,000).
    """
    spark = universe.sparkSession
    prepare(spark)
    rows = hashed(spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")).collect()
    yes = np.array([(r.h1, r.h2) for r in rows], np.int64).astype(np.uint64).reshape(-1, 2)
    if not len(yes):
        return Cascade([])
    others = hashed(universe).filter(~F.col("key").isin([r.key for r in rows])) if len(rows) <= 1000 else hashed(universe).join(F.broadcast(spark.createDataFrame([(r.key,) for r in rows], "key string")), "key", "left_anti")
    n = universe.count()
    levels = [Level.of(yes, min(0.5, len(yes) / (math.sqrt(2) * max(n, 1))), 0)]
    bound = int(max(1000, growth * len(yes)))
    found = others.mapInArrow(_passing(levels[0]), "h1 long, h2 long").limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"level 0 lets through more than {bound} unlisted keys")
    no = np.array([(r.h1, r.h2) for r in found], np.int64).astype(np.uint64).reshape(-1, 2)
    if {tuple(x) for x in no.tolist()} & {tuple(x) for x in yes.tolist()}:
        raise ValueError("a listed and an unlisted key share both 64-bit hashes")
    inside, outside = no, yes  # what the next level encodes, and what it must not hold
    while len(inside):
        levels.append(Level.of(inside, 0.5, len(levels)))
        inside, outside = outside[levels[-1].has(outside)], inside
    return Cascade(levels)


def _passing(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.stack([b.column(i).to_numpy().astype(np.uint64) for i in (1, 2)], 1)
            yield b.select([1, 2]).filter(pa.array(level.has(pairs)))

    return run


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's host, path, fitting rule (the longest key) and verdict, `default` where none fits.

    One cascade for each verdict; a page's keys are tried against both, without a join.
    """
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    lengths = sorted({len(r.path) for r in rules})
    base = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = base.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    verdicts = sorted({r.verdict for r in rules})
    cascades = [build_cascade(universe, [r.key for r in rules if r.verdict == v]) for v in verdicts]
    with_hashes = keyed.select("*", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)).alias("h2"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, h1, h2 = (b.column(b.schema.get_field_index(c)) for c in ("keys", "h1", "h2"))
            flat = keys.flatten()
            pairs = np.stack([h.flatten().to_numpy().astype(np.uint64) for h in (h1, h2)], 1)
            which = np.full(len(flat), -1)
            for i, cascade in enumerate(cascades):
                which[cascade.has(pairs)] = i
            row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))
            best: dict[int, tuple[tuple[int, int], str, int]] = {}
            for j in np.flatnonzero(which >= 0):
                key = flat[j].as_py()
                rank = (len(key), key.find("/"))
                if row[j] not in best or rank > best[row[j]][0]:
                    best[row[j]] = (rank, key, which[j])
            rule = [best[i][1] if i in best else None for i in range(len(keys))]
            verdict = [verdicts[best[i][2]] if i in best else default for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return with_hashes.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
