"""k-means partitioned index: training in integers, statistics, tiered probing.

Centroids and cluster statistics are bounded by the number of clusters and are broadcast; assignment and probe ranking are
matrix products with them, without a shuffle.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.constants import ESCALATE, LLOYD, PROBES, SAMPLE, TOP
from knnspark.functions.distance import box_bound, radius_bound
from knnspark.operators import blocks
from knnspark.operators.knn import nearest, vote

#: Clusters a query, on average, from which the nearest one is searched first.
FEW = 8


def seeds(ref: DataFrame, k: int) -> DataFrame:
    """cid, c: the k rows whose hashed id is smallest; a deterministic stand-in for random seeding."""
    first = ref.select("rid", "v", F.md5(F.col("rid").cast("string")).alias("h")).orderBy("h", "rid").limit(k)
    return first.withColumn("cid", (F.row_number().over(Window.orderBy("h", "rid")) - 1).cast("int")).select("cid", F.col("v").alias("c"))


def scores(q: DataFrame, centroids: DataFrame) -> DataFrame:
    """qid, cid, d, rn for all clusters, nearest first."""
    return blocks.ranked_centroids(q, centroids)


def assign(ref: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds cid and cd (squared distance); the lowest cid on ties."""
    return blocks.nearest_centroid(ref, centroids)


def _means(assigned: DataFrame, dims: int) -> DataFrame:
    return assigned.groupBy("cid").agg(F.array(*[F.floor(F.sum(F.col("v")[i]) / F.count(F.lit(1)) + 0.5).cast("int") for i in range(dims)]).alias("m"))


def step(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """Means, half up; an empty cluster keeps its centroid."""
    return centroids.join(_means(assigned, dims), "cid", "left").select("cid", F.coalesce("m", "c").alias("c"))


def train(ref: DataFrame, k: int, rounds: int, dims: int) -> DataFrame:
    """cid, c. The means are collected after each round (k rows), so no round repeats the ones before; each is a `step`."""
    spark = ref.sparkSession
    now = {r.cid: list(r.c) for r in seeds(ref, k).collect()}
    table = lambda: spark.createDataFrame(list(now.items()), "cid int, c array<int>")
    for _ in range(rounds):
        now |= {r.cid: list(r.m) for r in _means(assign(ref.select("rid", "v"), table()), dims).collect()}
    return table()


def spread_seeds(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means++: each further seed is a row drawn in proportion to its squared distance to the nearest seed so far."""
    chosen = [int(random.integers(len(x)))]
    near = blocks.squares(x, x[chosen])[:, 0]
    while len(chosen) < k:
        mass = np.cumsum(near.astype(np.float64))
        at = int(np.searchsorted(mass, random.random() * mass[-1], "right")) if mass[-1] > 0 else int(random.integers(len(x)))
        chosen.append(min(at, len(x) - 1))
        near = np.minimum(near, blocks.squares(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def train_sampled(ref: DataFrame, k: int, rounds: int = LLOYD, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """cid, c: k-means on the driver over the `sample` rows with the smallest hash, seeded by k-means++; means half up, empty clusters stay."""
    spark, random = ref.sparkSession, np.random.default_rng(seed)
    x = blocks.ints(ref.select("v", "rid").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid").limit(sample).toArrow().column("v"))
    now = spread_seeds(x, min(k, len(x)), random) if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = np.concatenate([blocks.squares(x[at : at + 2048], now).argmin(axis=1) for at in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(now))
        total = np.stack([np.bincount(near, x[:, i], len(now)) for i in range(x.shape[1])], 1)
        now = np.where(n[:, None] > 0, np.floor(total / np.maximum(n, 1)[:, None] + 0.5).astype(np.int64), now)
    return spark.createDataFrame([(i, c) for i, c in enumerate(now.tolist())], "cid int, c array<int>")


def statistics(assigned: DataFrame, dims: int) -> DataFrame:
    """cid, n, bmin, bmax, radius2 of real members."""
    col = lambda f: F.array(*[f(F.col("v")[i]) for i in range(dims)])
    return assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), col(F.min).alias("bmin"), col(F.max).alias("bmax"), F.max("cd").alias("radius2"))


def nearest_of(probes: DataFrame, q: DataFrame, assigned: DataFrame, dims: int, found: DataFrame | None = None) -> DataFrame:
    """The nearest of the probed clusters: the probes go to the members, block by block.

    found: neighbours known already; rows beyond a query's fifth one are not wanted, and may be missing.
    """
    last = None if found is None else blocks.last_of(found, TOP)

    def one(some: pa.Table, pairs: pa.Table) -> DataFrame:
        wanted = pa.table({"at": blocks.places(some, pairs.column("qid")), "key": pairs.column("cid")})
        if last is not None:
            return blocks.nearest(assigned, some, TOP, ["cid"], wanted, blocks.bound_of(some, last))
        if pairs.num_rows <= FEW * some.num_rows:
            return blocks.nearest(assigned, some, TOP, ["cid"], wanted)
        first = wanted.filter(pa.compute.equal(pairs.column("rn"), 1))  # its fifth distance bounds what matters of the others
        bound = blocks.bound_of(some, blocks.last_of(blocks.nearest(assigned, some, TOP, ["cid"], first), TOP))
        return blocks.nearest(assigned, some, TOP, ["cid"], wanted, bound)

    return blocks.each_block(q.select("qid", "qv"), one, blocks.QUERIES, probes.select("qid", "cid", "rn"))


def search(q: DataFrame, assigned: DataFrame, centroids: DataFrame, dims: int, probes: int = PROBES) -> DataFrame:
    """Fast tier only: the nearest in the first `probes` clusters."""
    ranks = scores(q, centroids).filter(F.col("rn") <= probes)
    return nearest_of(ranks, q, assigned, dims)


def gate(fast: DataFrame, thresholds: tuple[int, ...], more: tuple[int, ...] = ESCALATE) -> DataFrame:
    """qid, fraud_count, worst, escalate, extra: which queries look further, and how many clusters."""
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("fraud_count") + 1).cast("int"))
    limit = pick(thresholds)
    escalate = F.col("fraud_count").between(2, 4) | ((limit > 0) & (F.col("worst") > limit))
    return fast.select("qid", "fraud_count", "worst", escalate.alias("escalate"), F.when(escalate, pick(more)).otherwise(0).alias("extra"))


def tiered(q: DataFrame, assigned: DataFrame, centroids: DataFrame, dims: int, probes: int, thresholds: tuple[int, ...], more: tuple[int, ...]) -> DataFrame:
    """Fast tier, then `more[count]` further clusters for gated queries, whose rows join those of the fast tier."""
    ranks = scores(q, centroids)
    fast = nearest_of(ranks.filter(F.col("rn") <= probes), q, assigned, dims).persist()
    gated = gate(vote(fast), thresholds, more)
    wanted = ranks.filter((F.col("rn") > probes) & (F.col("rn") <= probes + max(more))).join(gated.select("qid", "extra"), "qid")
    further = nearest_of(wanted.filter(F.col("rn") <= probes + F.col("extra")), q, assigned, dims, fast)
    return nearest(fast.unionByName(further).drop("rn"))


def banded(ranks: DataFrame, q: DataFrame, assigned: DataFrame, dims: int, fast: DataFrame, probes: int, further: list[int]) -> dict[int, DataFrame]:
    """By number of further clusters: the nearest with so many of them searched beyond the first `probes`, whose nearest are `fast`.

    ranks: those of the queries that look further. Each cluster is searched once.
    """
    bands, out, done = fast, {}, 0
    for n in sorted(further):
        if n > done:
            band = ranks.filter((F.col("rn") > probes + done) & (F.col("rn") <= probes + n))
            bands, done = bands.unionByName(nearest_of(band, q, assigned, dims, fast).persist()), n
        out[n] = nearest(bands.drop("rn")) if n else fast
    return out


def pruned(q: DataFrame, assigned: DataFrame, centroids: DataFrame, stats: DataFrame, dims: int, probes: int) -> DataFrame:
    """Exact: the fast tier's fifth distance bounds which other clusters can matter, by box and by radius."""
    fast = search(q, assigned, centroids, dims, probes).persist()
    bound = fast.groupBy("qid").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n"))
    tau = q.select("qid", "qv").join(bound, "qid", "left").withColumn("tau", F.when(F.col("n") >= 5, F.col("worst")).otherwise(F.lit(2**62)))
    boxes = scores(q, centroids).join(F.broadcast(stats), "cid").join(tau.select("qid", "qv", "tau"), "qid")
    box = box_bound(F.col("qv"), F.col("bmin"), F.col("bmax"), dims)
    ball = radius_bound(F.col("d"), F.sqrt(F.col("radius2").cast("double")))
    keep = boxes.filter((box <= F.col("tau")) & (ball <= F.col("tau") + 1)).select("qid", "cid", "rn")
    further = nearest_of(keep.filter(F.col("rn") > probes), q, assigned, dims, fast)
    return nearest(fast.unionByName(further).drop("rn"))
