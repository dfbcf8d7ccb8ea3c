"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by a hash of their id. In a shard, greedy searches propose neighbours of each vector, and
relaxed distance pruning keeps the diverse ones: a candidate goes if a kept neighbour is `alpha` times nearer to it than the
vector is. Edges are added both ways, and overfull lists pruned again. Queries walk each shard's graph with a beam; scores
are the exact inner products of the original vectors in double precision, and the shards' lists are merged.

Largest inner product becomes least distance by one more dimension, which gives all of a shard's vectors equal norms.
Shards and query blocks are bounded in size; each (shard, block) pair is one row of work.

Copies of a vector are one node of their shard's graph with a sorted list of ids, so that they take no edges or beam places from
others; what a walk finds is expanded to the smallest ids.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; with fewer candidates than k all
are returned; ties go to the smaller id; rows that repeat an id are candidates each, but never for their own id's query;
empty tables give empty results; other columns are ignored; vectors of unequal lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.llm.common import Scratch, prepare
from knnspark.llm.vectors import matrix, plain, usable


def equal_norms(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], 1).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, expand: int = 4, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For all rows of q at once: the beam's nodes, nearest first, and their squared distances.

    graph: neighbours of each node, -1 where there are fewer. visited: gets the number of nodes that each walk has seen.
    """
    n, rows = len(x), np.arange(len(q))
    norms = (x * x).sum(1)
    nodes = np.full((len(q), beam), -1)
    dist = np.full((len(q), beam), np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    seen = np.zeros((len(q), n + 1), bool)
    nodes[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    seen[:, n] = True  # stands for missing neighbours
    dist[:, 0] = norms[entry] - 2 * (q @ x[entry])
    while True:
        waiting = np.where(done, np.inf, dist)
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :expand]
        active = np.isfinite(np.take_along_axis(waiting, pick, 1))
        if not active.any():
            if visited is not None:
                visited.extend(seen[:, :n].sum(1).tolist())
            return nodes, dist
        live = np.flatnonzero(active.any(1))
        pick, active = pick[live], active[live]
        from_ = np.where(active, np.take_along_axis(nodes[live], pick, 1), -1)
        marks = done[live]
        np.put_along_axis(marks, pick, True, 1)
        done[live] = marks
        new = np.where(from_[:, :, None] >= 0, graph[from_], -1).reshape(len(live), -1)
        new = np.sort(np.where(new < 0, n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        at = np.where(fresh, new, 0)
        d = norms[at] - 2 * np.einsum("ij,ikj->ik", q[live], x[at])
        d[~fresh] = np.inf
        both_d = np.concatenate([dist[live], d], 1)
        both_n = np.concatenate([nodes[live], np.where(fresh, new, -1)], 1)
        both_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(both_d, axis=1, kind="stable")[:, :beam]
        dist[live], nodes[live], done[live] = (np.take_along_axis(a, order, 1) for a in (both_d, both_n, both_done))


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` diverse neighbours for each node of `of`; candidates: a row for each, -1 where there are fewer."""
    y = x[np.maximum(candidates, 0)]
    d = ((y - x[of][:, None]) ** 2).sum(2)
    d[(candidates < 0) | (candidates == of[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    y = x[np.maximum(candidates, 0)]
    d[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
    norms = (y * y).sum(2)
    apart = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
    out, alive, rows = np.full((len(of), degree), -1), np.isfinite(d), np.arange(len(of))
    for k in range(degree):
        first = alive.argmax(1)
        there = alive[rows, first]
        if not there.any():
            break
        out[there, k] = candidates[rows, first][there]
        alive &= ~(alpha * apart[rows, first] <= d)
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbour lists and the entry node (the one nearest to the mean)."""
    n, random = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = random.integers(0, n, (n, degree))
    for relax in (1.0, alpha**2):  # distances are squared
        for at in np.array_split(random.permutation(n), -(-n // batch)):
            found, _ = beam_search(x, graph, entry, x[at], beam)
            graph[at] = robust_prune(x, at, np.concatenate([found, graph[at]], 1), degree, relax)
            to, back = graph[at].ravel(), np.repeat(at, degree)
            to, back = to[to >= 0], back[to >= 0]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            nodes, start, many = np.unique(to, return_index=True, return_counts=True)
            for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) // 1024)):
                extra = np.full((len(part), int(many[part].max())), -1)
                for i, j in enumerate(part):
                    extra[i, : many[j]] = back[start[j] : start[j] + many[j]]
                whole = np.concatenate([graph[nodes[part]], extra], 1)
                graph[nodes[part]] = robust_prune(x, nodes[part], whole, degree, relax)
    return graph, entry


def search(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 20_000, block_rows: int = 2000, degree: int = 32, beam: int = 96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that were found for all rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    prepare(spark)
    good = plain(vectors, id_col, vec_col).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n = good.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // every // block_rows))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        raw, node = np.unique(raw + 0.0, axis=0, return_inverse=True)  # -0.0 becomes 0.0
        node = node.ravel()
        ids = pdf["vec_id"].to_numpy(np.int64)[np.argsort(node, kind="stable")]
        graph, entry = build_graph(equal_norms(raw), min(degree, max(1, len(raw) - 1)))
        return pd.DataFrame([(pdf["shard"].iloc[0], entry, ids.tobytes(), np.bincount(node).tobytes(), raw.tobytes(), graph.astype(np.int32).tobytes())], columns=["shard", "entry", "ids", "copies", "raw", "graph"])

    sharded = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    indexes = Scratch(spark).keep(sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(index, "shard int, entry int, ids binary, copies binary, raw binary, graph binary"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame([(pdf["block"].iloc[0], pdf["vec_id"].to_numpy(np.int64).tobytes(), raw.tobytes())], columns=["block", "q_ids", "q_raw"])

    queries = good.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))
    bundles = queries.groupBy("block").applyInPandas(bundle, "block int, q_ids binary, q_raw binary")
    work = indexes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(bundles, "block").repartition(max(1, shards * blocks), "shard", "block")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                copies = np.frombuffer(r["copies"], np.int64)
                raw, q_raw = (np.frombuffer(r[c], np.float64).reshape(len(i), -1) for c, i in (("raw", copies), ("q_raw", q_ids)))
                graph = np.frombuffer(r["graph"], np.int32).reshape(len(copies), -1)
                start, most = np.cumsum(copies) - copies, k + int(np.unique(ids, return_counts=True)[1].max())  # a query's own id may repeat
                q = np.concatenate([q_raw, np.zeros((len(q_raw), 1))], 1).astype(np.float32)
                x = equal_norms(raw)
                for at in range(0, len(q), 500):
                    nodes, _ = beam_search(x, graph, r["entry"], q[at : at + 500], max(beam, 2 * k))
                    score = np.einsum("ij,ikj->ik", q_raw[at : at + 500], raw[np.maximum(nodes, 0)])
                    of, place = np.nonzero(nodes >= 0)
                    node = nodes[of, place]
                    many = np.minimum(copies[node], most)
                    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    found, score, of = ids[np.repeat(start[node], many) + nth], np.repeat(score[of, place], many), np.repeat(of, many)
                    other = found != q_ids[at + of]
                    found, score, of = found[other], score[other], of[other]
                    order = np.lexsort((found, -score, of))
                    found, score, of = found[order], score[order], of[order]
                    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + of][keep]), pa.array(found[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    hits = work.mapInArrow(walk, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
