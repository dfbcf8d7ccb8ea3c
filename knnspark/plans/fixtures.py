"""Views that derive the engine's inputs from the test tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knnspark.constants import MCC_RISK
from knnspark.functions import features as X
from knnspark.functions.quantize import signed

CODES = [*MCC_RISK, "0000"]
#: A search's stated queries: rows whose id is divisible by this.
EVERY = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), signed(F.col("embedding")).alias("v"), F.when(F.col("label") < 3, 1).otherwise(0).alias("label"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction for each event, with what its user and merchant did before."""
    e = events(spark, sf_dir)
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    merchants = e.groupBy("k").agg(F.sum("cents").alias("ms"), F.count(F.lit(1)).alias("mc"))
    rows = e.select(
        "*", F.lag("ts").over(u).alias("last_ts"), F.lag("k").over(u).alias("last_k"),
        F.count(F.lit(1)).over(past(u)).alias("prev_n"), F.coalesce(F.sum("cents").over(past(u)), F.lit(0)).alias("prev_cents"),
        F.count(F.lit(1)).over(past(m)).alias("seen"),
        F.expr("count(1) over (partition by user_id order by ts range between interval 24 hours preceding and current row) - 1").alias("tx24"),
    ).join(merchants, "k")
    codes = F.array(*[F.lit(c) for c in CODES])
    return rows.select(
        "event_id", "ts", "user_id", "k", "cents", "last_ts", "last_k", "prev_n", "prev_cents", "seen", "tx24", "event_type",
        (F.col("cents") * 20 / F.lit(100.0)).alias("amount"), (F.col("k") % 12 + 1).alias("installments"),
        F.when(F.col("prev_n") > 0, F.col("prev_cents") / F.when(F.col("prev_n") > 0, F.col("prev_n")) / 100 * 20).otherwise(F.lit(0.0)).alias("avg_amount"),
        F.element_at(codes, F.col("k") % 11 + 1).alias("mcc"), (F.col("ms") / F.col("mc") / 100 * 20).alias("merchant_avg"),
        F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("event_id") * 37 % 1200).alias("km_home"), (F.abs(F.col("k") - F.col("last_k")) * 10).alias("km_last"),
        F.when((F.col("event_type") == "error") | (F.col("cents") > 12000), 1).otherwise(0).alias("label"),
    )


def vector() -> Column:
    """The 14 features of a row of `tx`."""
    c = F.col
    return F.array(
        X.amount(c("amount")), X.installments(c("installments")), X.amount_vs_avg(c("amount"), c("avg_amount")),
        X.hour_of_day(c("ts")), X.day_of_week(c("ts")), X.minutes_since(c("ts"), c("last_ts")), X.km_since(c("km_last"), c("last_ts")),
        X.km_from_home(c("km_home")), X.tx_count_24h(c("tx24")), X.flag(c("is_online")), X.flag(c("card_present")), X.flag(c("seen") == 0),
        X.mcc_risk(c("mcc")), X.merchant_avg(c("merchant_avg")),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, v (14 features), label, pkey of all transactions."""
    return tx(spark, sf_dir).select(F.col("event_id").alias("rid"), vector().alias("v"), "label").withColumn("pkey", X.key8(F.col("v")))


def queries_of(ref: DataFrame) -> DataFrame:
    """The stated query set of a reference table."""
    return ref.filter(F.col("rid") % EVERY == 0).select(F.col("rid").alias("qid"), F.col("v").alias("qv"), *[c for c in ref.columns if c not in ("rid", "v")])
