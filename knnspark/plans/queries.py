"""One query for each operator of the engine, over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knnspark.constants import DIMS, TOP
from knnspark.functions import decision, distance, features, quantize
from knnspark.operators import evaluate, index, ivf, knn, partitioned
from knnspark.plans import fixtures as X
from knnspark.plans.settings import EXTRA, K, LEAF, PROBES, ROUNDS, THRESHOLDS, UNIFORM
from knnspark.schema import REQUEST
from knnspark.sources import io
from knnspark.streaming import score as streaming

OUT = ["qid", "rid", "d", "label", "rn"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def simple(name: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(f(spark, sf_dir))


def query(f: Callable) -> Callable:
    simple(f.__name__, f)
    return f


def flat(df: DataFrame) -> DataFrame:
    """Vectors as text: every column is then one that both engines print alike."""
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n, kind in df.dtypes if kind.startswith("array")})


class Index:
    """The clustered index over all transactions, with what the searches share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.ref = X.vectors(spark, sf_dir).persist()
        self.q = X.queries_of(self.ref)
        self.centroids = ivf.train(self.ref, K, ROUNDS, DIMS)
        self.assigned = ivf.assign(self.ref, self.centroids).persist()

    @property
    def stats(self) -> DataFrame:
        return ivf.statistics(self.assigned, DIMS)

    @property
    def ranks(self) -> DataFrame:
        return ivf.scores(self.q, self.centroids)

    def fast(self) -> DataFrame:
        return ivf.search(self.q, self.assigned, self.centroids, DIMS, PROBES)

    def gate(self) -> DataFrame:
        return ivf.gate(knn.vote(self.fast()), THRESHOLDS, EXTRA)

    def tiered(self, more: tuple[int, ...]) -> DataFrame:
        return ivf.tiered(self.q, self.assigned, self.centroids, DIMS, PROBES, THRESHOLDS, more)

    def exact(self) -> DataFrame:
        """By partitions: as brute force, with less to compare."""
        return partitioned.search(self.q, self.ref, partitioned.boxes(self.ref, ["pkey"], DIMS), DIMS, ["pkey"])

    def records(self) -> DataFrame:
        fast = knn.vote(self.fast()).select("qid", F.col("fraud_count").alias("fast_count"), F.col("worst").alias("fast_worst"))
        full = knn.vote(self.exact()).select("qid", F.col("fraud_count").alias("full_count"))
        return fast.join(full, "qid").join(self.q.select("qid", (F.col("label") == 0).alias("expected")), "qid")

    def sweep(self, values: list[int], gated: bool) -> DataFrame:
        """extra_n, qid, fast_count, count: each further cluster of a query is searched once, a setting takes what it may see."""
        fast = self.fast().persist()
        gate = ivf.gate(knn.vote(fast), THRESHOLDS, EXTRA).select("qid", "escalate", F.col("fraud_count").alias("fast_count")).persist()
        ranks = self.ranks
        if gated:
            ranks = ranks.join(gate.filter("escalate").select("qid"), "qid")
        tops = ivf.banded(ranks, self.q, self.assigned, DIMS, fast, PROBES, values)
        votes = [top.groupBy("qid").agg(F.sum("label").alias("count")).withColumn("extra_n", F.lit(v)) for v, top in tops.items()]
        return reduce(DataFrame.unionByName, votes).join(gate.select("qid", "fast_count"), "qid").join(self.q.select("qid", F.col("label").alias("ql")), "qid")


def errors(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(evaluate.count_if((F.col("count") > 2) & (F.col("ql") == 0)).alias("fp"), evaluate.count_if((F.col("count") <= 2) & (F.col("ql") == 1)).alias("fn"))


def of_vectors(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    simple(name, lambda s, d: f(X.vectors(s, d)))


def of_tx(name: str, *columns) -> None:
    simple(name, lambda s, d: X.tx(s, d).select("event_id", *[c() if callable(c) else c for c in columns]))


def of_index(name: str, f: Callable[[Index], DataFrame]) -> None:
    simple(name, lambda s, d: f(Index(s, d)))


def of_exact(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """f gets the exact neighbours of the stated transactions."""

    def run(s: SparkSession, d: str) -> DataFrame:
        ref = X.vectors(s, d).persist()
        return f(knn.brute(X.queries_of(ref), ref, DIMS))

    simple(name, run)


def brute64(s: SparkSession, d: str) -> DataFrame:
    ref = X.vec64(s, d)
    return knn.brute(X.queries_of(ref), ref, 64)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share: the checkpoint folder, else the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


c = F.col
# sources
simple("src_reference_scan", X.vec64)
simple("src_arity_check", lambda s, d: io.arity(X.read(s, d, "embeddings"), "embedding", 64))
simple("label_decode", lambda s, d: X.read(s, d, "embeddings").select("vec_id", io.label_code(F.when(c("label") < 3, "fraud").otherwise("legit")).alias("label")))
of_index("debug_info", lambda x: x.assigned.agg(F.count(F.lit(1)).alias("dataset_count"), F.countDistinct("cid").alias("k")))


@query
def idx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Index(spark, sf_dir)
    path = shared_path(spark, "index")
    io.save_index(path, x.assigned, x.centroids, x.stats, K)
    return io.load_index(spark, path)[0].select("rid", "v", "label", "cid", "cd")


def request() -> Column:
    """A row of `tx` as a JSON request."""
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(
        c("event_id").cast("string").alias("id"),
        F.struct("amount", "installments", iso(c("ts")).alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", c("tx24").alias("tx_count_24h"), F.when(c("seen") > 0, F.array(c("k").cast("string"))).otherwise(F.array().cast("array<string>")).alias("known_merchants")).alias("customer"),
        F.struct(c("k").cast("string").alias("id"), "mcc", c("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", c("km_home").cast("double").alias("km_from_home")).alias("terminal"),
        F.when(c("last_ts").isNotNull(), F.struct(iso(c("last_ts")).alias("timestamp"), c("km_last").cast("double").alias("km_from_current"))).alias("last_transaction"),
    ))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and the transaction as a JSON request; every tenth is malformed."""
    return X.tx(spark, sf_dir).select("event_id", "label", "amount", request().alias("request"))


simple("src_explode_entries", lambda s, d: requests(s, d).select("event_id", F.explode(F.array(F.struct(F.from_json("request", REQUEST).alias("request"), (c("label") == 0).alias("expected")))).alias("e")).select("event_id", c("e.request.transaction.amount").alias("amount"), c("e.expected").alias("expected")))
simple("vectorize14", lambda s, d: requests(s, d).select(c("event_id").alias("rid"), F.from_json("request", REQUEST).alias("request"), "label").select("rid", features.vector().alias("v"), "label"))


@query
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = requests(spark, sf_dir).select(F.from_json(F.when(c("event_id") % 10 == 7, F.expr("substr(request, 1, 40)")).otherwise(c("request")), REQUEST).alias("request"))
    v = broken.select(features.vector().alias("v"))
    return v.agg(F.count(F.when(c("v").isNull(), 1)).alias("failed"), F.count("v").alias("parsed"))


# projections
NUMBER = lambda: F.when(c("k") % 6 == 0, "1e3").when(c("k") % 6 == 1, "-12.5").when(c("k") % 6 == 2, "abc").when(c("k") % 6 == 3, c("cents").cast("string")).when(c("k") % 6 == 4, "").otherwise("0.125")
simple("parse_number", lambda s, d: X.events(s, d).select("event_id", NUMBER().try_cast("double").alias("number")))
simple("quantize_clamp", lambda s, d: X.read(s, d, "events").select("event_id", quantize.clamp(c("value") / 100 - 0.1).alias("q")))
simple("quantize_sentinel", lambda s, d: X.read(s, d, "events").select("event_id", quantize.with_sentinel(F.when(c("event_id") % 3 == 0, F.lit(-1.0)).otherwise(c("value") / 100)).alias("q")))
of_tx("feat_amount_vs_avg", lambda: features.amount_vs_avg(c("amount"), c("avg_amount")).alias("q"))
simple("feat_day_number", lambda s, d: X.read(s, d, "events").select("event_id", features.day_number(c("ts")).alias("day_number")))
simple("feat_hour_dow", lambda s, d: X.read(s, d, "events").select("event_id", features.hour_of_day(c("ts")).alias("hour_q"), features.day_of_week(c("ts")).alias("dow_q")))
of_tx("feat_minutes_since_last", lambda: features.minutes_since(c("ts"), c("last_ts")).alias("q"))
of_tx("feat_last_tx_sentinel", lambda: features.minutes_since(c("ts"), c("last_ts")).alias("q5"), lambda: features.km_since(c("km_last"), c("last_ts")).alias("q6"))
of_tx("feat_bools", lambda: features.flag(c("is_online")).alias("online_q"), lambda: features.flag(c("card_present")).alias("present_q"))
of_tx("feat_unknown_merchant", lambda: features.flag(c("seen") == 0).alias("q"))
of_tx("feat_mcc_risk", "mcc", lambda: features.mcc_risk(c("mcc")).alias("q"))
of_vectors("partition_key8", lambda v: v.select("rid", "pkey"))
of_vectors("partition_key5", lambda v: v.select("rid", features.key5(c("v")).alias("key")))
of_vectors("bucket_mcc", lambda v: v.select("rid", features.mcc_bucket(c("v")).alias("bucket")))


@query
def grid_cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vectors(spark, sf_dir).select("rid", "v", features.key5(c("v")).alias("key"))
    cut = lambda dim, n: F.array(*[F.expr(f"percentile_disc({i / n}) within group (order by v[{dim}])") for i in range(1, n)])
    cuts = v.groupBy("key").agg(cut(0, 16).alias("a"), cut(12, 8).alias("b"), cut(6, 8).alias("c"))  # 32 keys at most
    below = lambda cuts, dim: F.size(F.filter(cuts, lambda x: x < c("v")[dim]))
    return v.join(F.broadcast(cuts), "key").select("rid", "key", (below(c("a"), 0) * 64 + below(c("b"), 12) * 8 + below(c("c"), 6)).alias("cell"))


@query
def dist_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vec64(spark, sf_dir)
    return knn.pairs(X.queries_of(ref).select("qid", "qv"), ref).select("qid", "rid", distance.l2sq(c("qv"), c("v"), 64).alias("d"))


@query
def dist_partial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of near rows, then eight dimensions, the rest for what is left."""
    ref = X.vectors(spark, sf_dir).persist()
    return partitioned.within(X.queries_of(ref), ref, TOP, 8)


@query
def aabb_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vectors(spark, sf_dir).persist()
    return partitioned.bounds(X.queries_of(ref), partitioned.boxes(ref, ["pkey"], DIMS), DIMS)


of_index("radius_lower_bound", lambda x: x.ranks.join(F.broadcast(x.stats), "cid").select("qid", "cid", F.round(distance.radius_bound(c("d"), F.sqrt(c("radius2").cast("double"))), 3).alias("lb")))
of_exact("score_decision", lambda top: knn.vote(top).select("qid", "fraud_count", decision.score(c("fraud_count")).alias("fraud_score"), decision.approved(c("fraud_count")).alias("approved")))
of_exact("render_response", lambda top: knn.vote(top).select("qid", decision.response(c("fraud_count")).alias("response")))
simple("score_p99", lambda s, d: X.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(decision.latency_score(c("l_extendedprice") / 20), 6).alias("score")))


@query
def score_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanics only: a share of the clean rows stands in for misses."""
    counts = X.read(spark, sf_dir, "labels").agg(evaluate.count_if((c("quality") == 0) & (c("toxic") == 1)).alias("fp"), F.floor(evaluate.count_if((c("quality") == 1) & (c("toxic") == 0)) / 400).alias("fn"), F.count(F.lit(1)).alias("n"))
    return counts.select("fp", "fn", "n", F.round(decision.detection_score(c("fp"), c("fn"), F.lit(0), c("n")), 6).alias("score"))


# searches
simple("knn5_brute", lambda s, d: brute64(s, d).select(*OUT))
simple("fraud_count", lambda s, d: knn.vote(brute64(s, d)).select("qid", "fraud_count"))
simple("worst_of_top5", lambda s, d: knn.vote(brute64(s, d)).select("qid", "worst"))
of_exact("knn5_tx_brute", lambda top: top.select(*OUT))
of_index("knn5_pruned", lambda x: ivf.pruned(x.q, x.assigned, x.centroids, x.stats, DIMS, PROBES).select(*OUT))
of_index("knn5_ivf_fast", lambda x: x.fast().select(*OUT))
of_index("knn5_ivf_full", lambda x: ivf.search(x.q, x.assigned, x.centroids, DIMS, K).select(*OUT))
of_index("knn5_ivf_topn", lambda x: x.tiered((UNIFORM,) * 6).select(*OUT))
of_index("knn5_ivf", lambda x: x.tiered(EXTRA).select(*OUT))
of_index("knn5_ivf_byclass", lambda x: knn.vote(x.tiered(EXTRA)))
of_index("escalation_gate", lambda x: x.gate())
of_index("escalate_next_n", lambda x: x.ranks.filter(c("rn") <= PROBES + max(EXTRA)).join(x.gate().select("qid", "extra"), "qid").filter((c("rn") > PROBES) & (c("rn") <= PROBES + c("extra"))).select("qid", "cid", "rn"))


@query
def knn5_specialist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vectors(spark, sf_dir).persist()
    return partitioned.search(X.queries_of(ref), ref, partitioned.boxes(ref, ["pkey"], DIMS), DIMS, ["pkey"]).select(*OUT)


@query
def knn5_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = partitioned.leaves(X.vectors(spark, sf_dir), DIMS, LEAF).persist()
    return partitioned.search(X.queries_of(ref), ref, partitioned.boxes(ref, ["pkey", "leaf"], DIMS), DIMS, ["pkey", "leaf"]).select(*OUT)


@query
def part_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vectors(spark, sf_dir).persist()
    parts = ref.groupBy("pkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")  # a directory with misses
    return partitioned.lookup(X.queries_of(ref), F.broadcast(parts)).select("qid", "pkey", F.coalesce("n", F.lit(-1)).alias("n"))


simple("known_merchant_semi", lambda s, d: (e := X.events(s, d)).join(e.groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id")).alias("first")), ["user_id", "k"], "inner").filter(F.struct("ts", "event_id") > c("first")).select("event_id"))
simple("unknown_merchant_anti", lambda s, d: (e := X.events(s, d)).join(QUERIES["known_merchant_semi"](s, d), "event_id", "left_anti").select("event_id"))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vectors(spark, sf_dir).persist()
    q = X.queries_of(ref)
    top = partitioned.search(q, ref, partitioned.boxes(ref, ["pkey"], DIMS), DIMS, ["pkey"])
    rows = knn.vote(top).join(q.select("qid", "label"), "qid")
    return evaluate.confusion(rows, decision.approved(c("fraud_count")), c("label") == 0)


# clusters
of_index("centroid_scores", lambda x: x.ranks.select("qid", "cid", "d"))
of_index("topn_centroids", lambda x: x.ranks.filter("rn <= 8").select("qid", "cid", "d", "rn"))
of_index("argmin_centroid", lambda x: x.ranks.groupBy("qid").agg(F.min_by("cid", F.struct("d", "cid")).alias("cid")))
of_index("cluster_sizes", lambda x: x.assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n")))
of_index("cluster_offsets", lambda x: x.assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).select("cid", (F.sum("n").over(Window.orderBy("cid")) - c("n")).alias("start")))
of_index("cluster_bbox", lambda x: x.stats.select("cid", "bmin", "bmax"))
of_index("cluster_radius", lambda x: x.stats.select("cid", F.round(F.sqrt(c("radius2").cast("double")), 6).alias("radius")))


@query
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = X.vectors(spark, sf_dir).persist()
    first = ivf.seeds(ref, K)
    return ivf.step(ivf.assign(ref, first), first, DIMS)


of_index("kmeans_assign", lambda x: x.assigned.select("rid", "cid", "cd"))
of_index("kmeans_inertia", lambda x: x.assigned.agg(F.sum("cd").alias("inertia")))
of_index("kmeans_train", lambda x: x.centroids)
of_index("cluster_member_rank", lambda x: x.assigned.select("rid", "cid", F.row_number().over(Window.partitionBy("cid").orderBy("cd", "rid")).alias("place")))
simple("label_counts", lambda s, d: X.tx(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")))

# calibration
of_index("calib_class_breakdown", lambda x: evaluate.class_breakdown(x.records()))
of_index("calib_thresholds", lambda x: evaluate.thresholds(x.records()))
of_index("calib_escalation_rate", lambda x: x.gate().agg(evaluate.count_if(c("escalate")).alias("escalated"), F.count(F.lit(1)).alias("n")).select("escalated", "n", F.round(c("escalated") / c("n"), 6).alias("rate")))
of_index("calib_topn_sweep", lambda x: errors(x.sweep([0, 2, 4, 8], gated=True), ["extra_n"]))
of_index("calib_perclass_sweep", lambda x: errors(x.sweep([0, 2, 4, 8], gated=False), ["extra_n", "fast_count"]))
simple("latency_percentiles", lambda s, d: evaluate.percentile_rows(X.read(s, d, "lineitem").select("l_extendedprice"), "l_extendedprice", [50, 90, 99]))
simple("run_medians", lambda s, d: X.read(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("vs"), F.count(F.lit(1)).alias("n")).select("user_id", F.element_at("vs", F.floor((c("n") + 1) / 2).cast("int")).alias("median"), "n"))

# partitions and trees
of_vectors("partition_counts", lambda v: v.groupBy("pkey").agg(F.count(F.lit(1)).alias("n")))
of_vectors("kdtree_split_level", lambda v: partitioned.leaves(v, DIMS, LEAF, 1).select("rid", "pkey", "leaf"))
of_vectors("kdtree_leaves", lambda v: partitioned.leaves(v, DIMS, LEAF).select("rid", "pkey", "leaf"))
of_vectors("leaf_bbox", lambda v: partitioned.boxes(partitioned.leaves(v, DIMS, LEAF), ["pkey", "leaf"], DIMS))
simple("partition_lb_rank", lambda s, d: aabb_lower_bound(s, d).select("qid", "pkey", F.rank().over(Window.partitionBy("qid").orderBy("lb", "pkey")).alias("place")))

# samples, windows, sets
of_exact("check_first20", lambda top: knn.vote(top).orderBy("qid").limit(20).select("qid", "fraud_count"))
of_vectors("sample_stride", lambda v: v.filter(c("rid") % X.EVERY == 0).select("rid", "label"))
simple("sample_hash", lambda s, d: X.read(s, d, "events").select("event_id", F.md5(c("event_id").cast("string")).alias("h")).orderBy("h", "event_id").limit(100).select("event_id"))
of_tx("win_lag_last_tx", lambda: F.coalesce(features.minute(c("last_ts")), F.lit(-1)).alias("last_minute"), lambda: F.coalesce("last_k", F.lit(-1)).alias("last_k"))
of_tx("win_tx_count_24h", "tx24")
of_tx("win_running_avg", "prev_n", "prev_cents", lambda: F.round("avg_amount", 6).alias("avg_amount"))
of_tx("win_seen_merchant", "seen")
of_index("scanned_union", lambda x: x.ranks.filter(c("rn") <= PROBES).select("qid", "cid").union(x.ranks.join(x.gate().select("qid", "extra"), "qid").filter(c("rn") <= PROBES + c("extra")).select("qid", "cid")).distinct())
of_index("unscanned_except", lambda x: x.ranks.select("qid", "cid").exceptAll(x.ranks.filter(c("rn") <= PROBES).select("qid", "cid")))
of_index("knn_recall_at5", lambda x: knn.recall(x.fast(), x.exact()))
of_index("count_mismatch", lambda x: x.records().agg(evaluate.count_if(c("fast_count") != c("full_count")).alias("mismatches"), F.count(F.lit(1)).alias("n")))

# index objects, settings, artifacts
@query
def score_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated requests, scored through a partitioned index that was saved and loaded.

    Transactions are made once and written, vectors and requests together: each later plan, and each cached one, then begins at a scan.
    """
    path, made = shared_path(spark, "tree"), shared_path(spark, "transactions")
    asked = c("event_id") % X.EVERY == 0
    t = X.tx(spark, sf_dir).select("event_id", X.vector().alias("v"), "label", F.when(asked, request()).alias("request"))
    t.write.parquet(made)
    t = spark.read.schema(t.schema).parquet(made)
    index.Partitioned.build(t.select(c("event_id").alias("rid"), "v", "label")).save(path)
    return streaming.score(t.filter(asked).select(c("event_id").cast("string").alias("id"), "request"), index.Partitioned.load(spark, path))


@query
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.Partitioned.build(X.vectors(spark, sf_dir)).info().select("dataset_count")


@query
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label counts as a run's results, written and read again."""
    path = shared_path(spark, "run")
    counts = QUERIES["label_counts"](spark, sf_dir)
    io.save_run(path, counts, {"run_id": "labels", "input": sf_dir}, counts.agg(F.sum("n").alias("rows")))
    return spark.read.schema("label int, n long").json(f"{path}/results")


simple("kmeans_plusplus", lambda s, d: ivf.train_sampled(X.vectors(s, d), K))
simple("synthetic_queries", lambda s, d: index.synthetic_queries(s, 1000))
simple("config_int", lambda s, d: X.events(s, d).select("event_id", quantize.positive_int(F.when(c("k") % 5 == 0, "abc").when(c("k") % 5 == 1, "").when(c("k") % 5 == 2, (c("k") - 20).cast("string")).when(c("k") % 5 == 3, "1.5").otherwise(c("cents").cast("string")), 8).alias("setting")))

# streams
simple("load_shed", lambda s, d: streaming.shed(X.read(s, d, "events").withColumn("batch", F.date_trunc("hour", "ts")), "batch", "event_id", 4).select("event_id", "shed"))
simple("stub_mode", lambda s, d: streaming.score(requests(s, d).select(c("event_id").cast("string").alias("id"), "request"), X.vectors(s, d).filter("false")).select("id", "fraud_count", "approved"))


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of the stated requests, scored batch by batch against all transactions."""
    at = shared_path(spark, "stream")
    requests(spark, sf_dir).filter(c("event_id") % X.EVERY == 0).select(c("event_id").cast("string").alias("id"), "request").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("id string, request string").parquet(f"{at}/in")
    done = streaming.start(stream, X.vectors(spark, sf_dir), lambda rows, number: rows.write.mode("append").parquet(f"{at}/out"), f"{at}/state")
    done.awaitTermination()
    return spark.read.parquet(f"{at}/out")
