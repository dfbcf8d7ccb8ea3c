"""Embedding near-duplicates by NN-descent.

Exact copies are one node. Random hyperplanes deal nodes to blocks of bounded size, several times; a block's nearest pairs
start the neighbour graph (the block's pivots are in all pieces of an overfull block, so that pieces stay connected). Rounds of
neighbours-of-neighbours joins then refine it: at each node its neighbours meet, and pairs nearer than either's worst neighbour
are proposed. Edges from the threshold up join components.

A list whose worst neighbour is still at the threshold is saturated: it is doubled and its node's neighbours meet again, up to
`largest` entries. Nodes that are saturated even then are dense. Links with a node that isn't dense are in that node's list. Dense
nodes look for links outside their component, which joins components, and those of one component are counted against each other
block by block: no pair is emitted, and blocks whose bounding caps decide all their pairs aren't compared. Only that step is
quadratic, in the dense nodes of one component.

Then `audit` nodes, drawn anew each time, are counted against all rows. Links they lost go into the graph, with another random
partition and round, until none is lost; after `most` audits a recall below `target` is an error. The recall is logged.

Cosines are compared in double precision. Edge cases: vectors that are null, zero or hold null or non-finite components link
with nothing and are their own component; copies link with each other; rows that repeat an id are one vector with the links of each
(one result row each); a null id has no links; empty tables give empty results; other columns are ignored; vectors of unequal
lengths are an error.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.llm.common import Scratch, prepare
from knnspark.llm.components import components
from knnspark.llm.vectors import matrix, plain, usable

PAIRS = "u long, v long, s double"
log = logging.getLogger(__name__)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def _nearest(ids: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """Each row's k largest entries."""
    k = min(k, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(s, at, 1)
    out = pd.DataFrame({"u": np.repeat(ids[0], k), "v": ids[1][at].ravel(), "s": got.ravel()})
    return out[np.isfinite(out["s"]) & (out["u"] != out["v"])]


def _blocks(nodes: DataFrame, seed: int, n: int, k: int, size: int = 1000) -> DataFrame:
    """Nearest pairs of different heads within blocks of one random partition of the n nodes."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / 500))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            if len(x):
                code = (x @ _planes(x.shape[1], bits, seed) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64))], names=[*b.schema.names, "code"])

    dealt = nodes.select("id", "head", "x").mapInArrow(deal, "id long, head long, x array<double>, code long")
    sizes = dealt.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id").alias("h"), "id", "head", "x")).alias("p1"), F.max(F.struct(F.xxhash64("id").alias("h"), "id", "head", "x")).alias("p2")).withColumn("pieces", F.ceil(F.col("n") / size).cast("int"))
    rows = dealt.join(sizes.select("code", "pieces"), "code").select("code", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("pieces")).cast("int").alias("piece"), "id", "head", "x")
    pivots = sizes.filter("pieces > 1").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("p", F.explode(F.array("p1", "p2"))).select("code", "piece", F.col("p.id").alias("id"), F.col("p.head").alias("head"), F.col("p.x").alias("x"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        x, ids, head = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy(), pdf["head"].to_numpy()
        s = x @ x.T
        s[head[:, None] == head[None, :]] = -np.inf
        return _nearest((ids, ids), s, k)

    return rows.unionByName(pivots).groupBy("code", "piece").applyInPandas(inside, PAIRS)


def _best(pairs: DataFrame, k: int, limits: DataFrame | None = None) -> DataFrame:
    """Each node's k nearest, or as many as `limits` (u, most) says; both ways count."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).groupBy("u", "v").agg(F.max("s").alias("s"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    if limits is None:
        return ranked.filter(F.col("r") <= k).drop("r")
    return ranked.join(limits, "u", "left").filter(F.col("r") <= F.coalesce("most", F.lit(k))).drop("r", "most")


def _saturated(graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """u: nodes with at least k neighbours, all linked."""
    return graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("worst")).filter((F.col("n") >= k) & (F.col("worst") >= threshold)).select("u")


def _round(nodes: DataFrame, graph: DataFrame, k: int, n: int, at: DataFrame | None = None, bar: float | None = None, share: int = 256) -> DataFrame:
    """Neighbours of neighbours: at each node (or those of `at`), its neighbours in either direction meet.

    Each proposes its k nearest there that are nearer than either's worst neighbour (or from `bar` up). About `share` nodes are one group.
    """
    worst = graph.groupBy(F.col("u").alias("id")).agg(F.min("s").alias("worst"))
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= k).drop("r")
    meets = graph.unionByName(back).select("u", F.col("v").alias("id")).distinct()
    if at is not None:
        meets = meets.join(at, "u", "left_semi")
    rows = meets.join(nodes.select("id", "x").join(worst, "id"), "id").withColumn("g", F.pmod(F.xxhash64("u"), F.lit(max(1, n // share))).cast("int"))

    def meet(group: pa.Table) -> pa.Table:
        u, ids, worst = (group.column(c).to_numpy() for c in ("u", "id", "worst"))
        x, order = matrix(group.column("x")), np.argsort(u, kind="stable")
        out = []
        for of in np.split(order, np.flatnonzero(np.diff(u[order])) + 1):
            s = x[of] @ x[of].T
            np.fill_diagonal(s, -np.inf)
            s[s < bar if bar is not None else s <= np.minimum(worst[of][:, None], worst[of][None, :])] = -np.inf
            width = min(k, len(of))
            best = np.argpartition(-s, width - 1, axis=1)[:, :width]
            got = np.take_along_axis(s, best, 1)
            a, b = np.nonzero(np.isfinite(got))
            out.append((ids[of][a], ids[of][best[a, b]], got[a, b]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        a, b = np.minimum(a, b), np.maximum(a, b)
        _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        return pa.table({"u": a[first], "v": b[first], "s": s[first]})

    return rows.select("g", "u", "id", "worst", "x").groupBy("g").applyInArrow(meet, PAIRS)


def _meet(dense: DataFrame, threshold: float, size: int = 2000) -> DataFrame:
    """id, n: the rows of other vectors that dense nodes (id, head, copies, x) link with among the dense of their head.

    Blocks of one head meet in a ring, each the same number. A block's centre and angular radius come along: where they show that all
    pairs of two blocks link, or none, nothing is compared.
    """
    sizes = dense.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("pieces"))
    members = dense.join(sizes, "head").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "id"), F.col("pieces")).cast("int"))
    limit = float(np.arccos(threshold))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        c = x.mean(0)
        c /= max(float(np.sqrt((c * c).sum())), 1e-300)
        radius = float(np.arccos(np.clip(x @ c, -1, 1)).max()) if (c * c).sum() > 0.5 else float(np.pi)
        columns = (pdf[i].to_numpy(np.int64).tobytes() for i in ("id", "copies"))
        return pd.DataFrame([(pdf["head"].iloc[0], pdf["piece"].iloc[0], pdf["pieces"].iloc[0], x.shape[1], radius, c.tobytes(), *columns, x.tobytes())], columns=["head", "piece", "pieces", "dim", "radius", "centre", "ids", "copies", "xs"])

    blocks = members.select("head", "piece", "pieces", "id", "copies", "x").groupBy("head", "piece").applyInPandas(bundle, "head long, piece int, pieces int, dim int, radius double, centre binary, ids binary, copies binary, xs binary")
    left = blocks.withColumn("step", F.explode(F.expr("sequence(0, pieces div 2)"))).filter((F.col("step") * 2 < F.col("pieces")) | (F.col("piece") * 2 < F.col("pieces"))).withColumn("other", F.pmod(F.col("piece") + F.col("step"), F.col("pieces")))
    right = blocks.select("head", F.col("piece").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("radius", "centre", "ids", "copies", "xs")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                ids, copies, o_ids, o_copies = (np.frombuffer(r[c], np.int64) for c in ("ids", "copies", "o_ids", "o_copies"))
                centre, o_centre = (np.frombuffer(r[c], np.float64) for c in ("centre", "o_centre"))
                same, mine, others = r["step"] == 0, np.zeros(len(ids)), np.zeros(len(o_ids))
                apart, reach = float(np.arccos(np.clip(centre @ o_centre, -1, 1))), r["radius"] + r["o_radius"]
                if apart + reach < limit - 1e-6:
                    mine += o_copies.sum() - (copies if same else 0)
                    others += copies.sum()
                elif apart - reach <= limit + 1e-6:
                    x, y = (np.frombuffer(r[c], np.float64).reshape(-1, r["dim"]) for c in ("xs", "o_xs"))
                    for at in range(0, len(x), 500):
                        u, v = np.nonzero(x[at : at + 500] @ y.T >= threshold)
                        u += at
                        if same:  # copies of a node itself are counted apart
                            u, v = u[u != v], v[u != v]
                        mine += np.bincount(u, o_copies[v], len(ids))
                        others += np.bincount(v, copies[u], len(o_ids))
                found = [(ids, mine)] if same else [(ids, mine), (o_ids, others)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for c, _ in found])), pa.array(np.concatenate([m for _, m in found]).astype(np.int64))], names=["id", "n"])

    return left.join(right, ["head", "other"]).mapInArrow(meet, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _exact(nodes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """id, n: the rows that sampled nodes (id, x) link with among all, without their own copies."""
    spark = nodes.sparkSession
    at = spark.sparkContext.broadcast((np.array([r.id for r in sample], np.int64), np.array([r.x for r in sample])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = at.value
        total = np.zeros(len(ids))
        for b in batches:
            if len(b):
                s = (matrix(b.column("x")) @ y.T >= threshold) & (b.column("id").to_numpy()[:, None] != ids[None, :])
                total += b.column("copies").to_numpy() @ s
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total.astype(np.int64))], names=["id", "n"])

    return nodes.select("id", "copies", "x").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("exact"))


def _links_of(nodes: DataFrame, sample: list, threshold: float, k: int) -> DataFrame:
    """The links of sampled nodes, for each at most k of each task (more make its list saturated)."""
    spark = nodes.sparkSession
    at = spark.sparkContext.broadcast((np.array([r.id for r in sample], np.int64), np.array([r.x for r in sample])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = at.value
        had = np.zeros(len(ids), np.int64)
        for b in batches:
            if len(b):
                other = b.column("id").to_numpy()
                s = y @ matrix(b.column("x")).T
                s[(s < threshold) | (ids[:, None] == other[None, :])] = -np.inf
                u, v = np.nonzero(np.isfinite(s))
                nth = np.arange(len(u)) - np.searchsorted(u, u)
                u, v = u[keep := nth + had[u] < k], v[keep]
                had += np.bincount(u, minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(other[v]), pa.array(s[u, v])], names=["u", "v", "s"])

    return nodes.select("id", "x").mapInArrow(find, PAIRS)


def _enlarged(nodes: DataFrame, graph: DataFrame, k: int, largest: int, n: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The graph with saturated lists doubled until they end or reach `largest`, and the nodes (u) saturated even then."""
    while True:
        full = scratch.keep(_saturated(graph, k, threshold))
        if k >= largest or full.isEmpty():
            return graph, full
        k, had, has = min(2 * k, largest), 0, 1
        while has > 1.001 * had:  # links only come, and lists end at k
            graph = scratch.keep(_best(graph.unionByName(_round(nodes, graph, k, n, full, threshold)), k))
            had, has = has, graph.filter(F.col("s") >= threshold).count()


def _linked(nodes: DataFrame, graph: DataFrame, dense: DataFrame, k: int, trees: int, threshold: float, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame]:
    """node, component and id, n (links with rows of other vectors)."""
    linked = graph.filter(F.col("s") >= threshold).select("u", "v")
    edges = linked.select(F.col("u").alias("a"), F.col("v").alias("b"))
    heads = scratch.keep(components(edges, scratch))
    crowd = nodes.drop("head").join(dense.withColumnRenamed("u", "id"), "id", "left_semi")
    with_head = lambda: scratch.keep(crowd.join(heads.select(F.col("node").alias("id"), F.col("component").alias("head")), "id"))
    inside, m = with_head(), dense.count()
    if m:
        out = _blocks(inside, 2000 + turn, m, k)
        for i in range(1, trees):
            out = out.unionByName(_blocks(inside, 2000 + turn + 100 * i, m, k))
        out = scratch.keep(out.filter(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
        if not out.isEmpty():
            heads = scratch.keep(components(edges.unionByName(out), scratch))
            inside = with_head()
    mark = dense.select("u", F.lit(True).alias("is_dense"))
    both = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = both.join(mark, "u", "left").join(mark.select(F.col("u").alias("v"), F.col("is_dense").alias("o_dense")), "v", "left").filter("is_dense is null or o_dense is null")
    few = both.join(nodes.select(F.col("id").alias("v"), "copies"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("n"))
    return heads, scratch.keep(few.unionByName(_meet(inside, threshold)).groupBy("id").agg(F.sum("n").alias("n")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = 12, trees: int = 3, rounds: int = 2, largest: int = 24, audit: int = 4096, most: int = 8, target: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    every = plain(vectors, id_col, vec_col)
    good = every.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", F.col("v").cast("array<double>").alias("v")).distinct()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _unit(matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "x"])

    unit = good.mapInArrow(units, "vec_id long, x array<double>").withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit("second"), "x"))
    unit = scratch.keep(unit)
    classes = unit.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies"))
    members = scratch.keep(unit.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "id", "copies"))
    nodes = scratch.keep(unit.join(classes, (unit.h1 == classes.h1) & (unit.h2 == classes.h2) & (unit.vec_id == classes.id)).select("id", F.col("id").alias("head"), "copies", "x"))
    n = nodes.count()
    pairs = _blocks(nodes, 1, n, k)
    for seed in range(2, trees + 1):
        pairs = pairs.unionByName(_blocks(nodes, seed, n, k))
    graph = scratch.keep(_best(pairs, k))
    for _ in range(rounds):
        graph = scratch.keep(_best(graph.unionByName(_round(nodes, graph, k, n)), k))
    for turn in range(1, most + 1):
        graph, dense = _enlarged(nodes, graph, k, largest, n, threshold, scratch)
        heads, counts = _linked(nodes, graph, dense, k, trees, threshold, scratch, turn)
        sample = nodes.join(counts, "id", "left").select("id", "x", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.xxhash64(F.lit(turn), "id"), "id").limit(audit).collect()
        exact = {r.id: r.exact for r in _exact(nodes, sample, threshold).collect()} if sample else {}
        lost = [r for r in sample if r.n < exact[r.id]]
        links = sum(exact.values())
        recall = 1 - sum(exact[r.id] - r.n for r in lost) / max(links, 1)
        log.info("audit %d: %d nodes, %d links, recall %.4f", turn, len(sample), links, recall)
        if not lost:
            break
        if turn == most and recall < target:
            raise RuntimeError(f"recall {recall:.4f} of {links} audited links is below {target} after {most} audits")
        if turn < most:
            more = _links_of(nodes, lost, threshold, largest).unionByName(_blocks(nodes, 1000 + turn, n, k))
            graph = scratch.keep(_best(graph.unionByName(more), largest))
            graph = scratch.keep(_best(graph.unionByName(_round(nodes, graph, k, n)), largest))
    of = members.join(heads.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    of = of.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of = of.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.select("vec_id").join(of, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
