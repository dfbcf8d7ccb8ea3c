"""The 14 features of a transaction, each one column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from knnspark import constants as C
from knnspark.functions.quantize import clamp


def amount(x: Column) -> Column:
    return clamp(x / C.MAX_AMOUNT)


def installments(n: Column) -> Column:
    return clamp(n / C.MAX_INSTALLMENTS)


def amount_vs_avg(x: Column, avg: Column) -> Column:
    """No average (null, zero or less) counts as the largest ratio."""
    return F.when(avg > 0, clamp(x / F.when(avg > 0, avg) / C.MAX_RATIO)).otherwise(C.SCALE)


def hour_of_day(ts: Column) -> Column:
    return clamp(F.hour(ts) / 23)


def day_of_week(ts: Column) -> Column:
    return clamp(F.weekday(ts) / 6)


def day_number(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("0001-01-01").cast("date")).cast("long")


def minute(ts: Column) -> Column:
    """Whole minutes since the epoch; truncated before any subtraction."""
    return F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / 60).cast("long")


def minutes_since(ts: Column, last: Column) -> Column:
    gap = F.greatest(minute(ts) - minute(last), F.lit(0))
    return F.when(last.isNull(), C.SENTINEL).otherwise(clamp(gap / C.MAX_MINUTES))


def km_since(km: Column, last: Column) -> Column:
    return F.when(last.isNull(), C.SENTINEL).otherwise(clamp(km / C.MAX_KM))


def km_from_home(km: Column) -> Column:
    return clamp(km / C.MAX_KM)


def tx_count_24h(n: Column) -> Column:
    return clamp(n / C.MAX_TX_24H)


def flag(b: Column) -> Column:
    return F.when(b, C.SCALE).otherwise(0)


def risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in C.MCC_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(C.MCC_DEFAULT))


def mcc_risk(mcc: Column) -> Column:
    return clamp(risk(mcc))


def merchant_avg(x: Column) -> Column:
    return clamp(x / C.MAX_MERCHANT_AVG)


def vector(request: str = "request") -> Column:
    """The 14 features of a parsed request struct; null if a required leaf is missing or malformed."""
    r = F.col(request)
    tx, customer, merchant, terminal, last = (r[x] for x in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    at = F.try_to_timestamp(tx["requested_at"]).cast("timestamp_ntz")
    before = F.try_to_timestamp(last["timestamp"]).cast("timestamp_ntz")
    unknown = ~F.coalesce(F.array_contains(customer["known_merchants"], merchant["id"]), F.lit(False))
    parts = [
        amount(tx["amount"]), installments(tx["installments"]), amount_vs_avg(tx["amount"], customer["avg_amount"]),
        hour_of_day(at), day_of_week(at), minutes_since(at, before), km_since(last["km_from_current"], before),
        km_from_home(terminal["km_from_home"]), tx_count_24h(customer["tx_count_24h"]), flag(terminal["is_online"]),
        flag(terminal["card_present"]), flag(unknown), mcc_risk(merchant["mcc"]), merchant_avg(merchant["avg_amount"]),
    ]
    needed = [tx["amount"], tx["installments"], at, customer["avg_amount"], customer["tx_count_24h"], merchant["id"], merchant["mcc"], merchant["avg_amount"], terminal["is_online"], terminal["card_present"], terminal["km_from_home"]]
    whole = F.lit(True)
    for x in needed:
        whole = whole & x.isNotNull()
    whole = whole & (last.isNull() | last["timestamp"].isNull() | before.isNotNull())
    return F.when(whole, F.array(*parts))


def key8(v: Column) -> Column:
    """Eight categorical bits of a 14-dimensional vector."""
    bit = lambda cond, n: F.when(cond, 1 << n).otherwise(0)
    return (
        bit(v[5] != C.SENTINEL, 0) + bit(v[9] > 5000, 1) + bit(v[10] > 5000, 2) + bit(v[11] > 5000, 3)
        + mcc_bucket(v) * 16 + bit(v[2] > 5000, 6) + bit(v[8] > 2500, 7)
    )


def key5(v: Column) -> Column:
    bit = lambda cond, n: F.when(cond, 1 << n).otherwise(0)
    return bit(v[9] > 5000, 0) + bit(v[10] > 5000, 1) + bit(v[11] > 5000, 2) + bit(v[5] == C.SENTINEL, 3) + bit(v[6] == C.SENTINEL, 4)


def mcc_bucket(v: Column) -> Column:
    return F.when(v[12] <= 2499, 0).when(v[12] <= 4999, 1).when(v[12] <= 7499, 2).otherwise(3)
