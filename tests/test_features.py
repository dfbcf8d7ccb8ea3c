import datetime
import json
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from knnspark.functions import features, quantize
from knnspark.schema import REQUEST
from knnspark.sources import io

BODY = {
    "id": "r-1",
    "transaction": {"amount": 250.5, "installments": 5, "requested_at": "2024-08-17T06:30:10Z"},
    "customer": {"avg_amount": 501.0, "tx_count_24h": 7, "known_merchants": ["shop-a", "shop-b"]},
    "merchant": {"id": "shop-z", "mcc": "5944", "avg_amount": 81.5},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": 125.5},
    "last_transaction": None,
}
REQ = json.dumps(BODY, separators=(",", ":"))


def expected(body):
    """The vector by exact fractions."""
    t, c, m, k = (body[x] for x in ("transaction", "customer", "merchant", "terminal"))
    at = datetime.datetime.fromisoformat(t["requested_at"])
    grid = lambda x: math.floor(min(max(Fraction(x), 0), 1) * 10000 + Fraction(1, 2))
    f = lambda x: Fraction(str(x))
    return [
        grid(f(t["amount"]) / 10000), grid(Fraction(t["installments"], 12)), grid(f(t["amount"]) / f(c["avg_amount"]) / 10), grid(Fraction(at.hour, 23)), grid(Fraction(at.weekday(), 6)), -10000, -10000,
        grid(f(k["km_from_home"]) / 1000), grid(Fraction(c["tx_count_24h"], 20)), grid(k["is_online"]), grid(k["card_present"]), grid(m["id"] not in c["known_merchants"]), 4500, grid(f(m["avg_amount"]) / 10000),
    ]


def vector(spark, request):
    row = spark.createDataFrame([(request,)], "r string").select(F.from_json("r", REQUEST).alias("request")).select(features.vector().alias("v")).first()
    return row.v


def test_request(spark):
    assert vector(spark, REQ) == expected(BODY)


@pytest.mark.parametrize("request_", ["", "{bad", "{}", REQ.replace("2024-08-17", "2024-18-17"), REQ.replace('"amount":250.5,', "")])
def test_malformed_requests_have_no_vector(spark, request_):
    assert vector(spark, request_) is None


def test_edges_of_a_request(spark):
    v = vector(spark, REQ.replace("501.0", "0").replace("125.5", "1e9").replace("5944", "9999").replace('"last_transaction":null', '"last_transaction":{"timestamp":"2024-08-18T00:00:00Z","km_from_current":5}'))
    assert (v[2], v[7], v[12], v[5], v[6]) == (10000, 10000, 5000, 0, 50)


def test_quantize_ends(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, -0.5, 0.0, 0.5, 1.0, 7.0)], "x double").select(quantize.with_sentinel(F.col("x")).alias("q"), quantize.clamp(F.col("x")).alias("c")).collect()
    assert [r.q for r in rows] == [-10000, 0, 0, 5000, 10000, 10000]
    assert [r.c for r in rows] == [0, 0, 0, 5000, 10000, 10000]


def test_reference_json_round_trip_and_arity(spark, tmp_path):
    import gzip
    import json

    rows = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1.0] * 14, "label": "legit"}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    got = io.reference_json(spark, str(tmp_path / "r.json.gz")).collect()
    assert sorted((r.label, r.v[0]) for r in got) == [(0, -10000), (1, 5000)]
    with open(tmp_path / "bad.json", "w") as f:
        json.dump([{"vector": [1.0], "label": "fraud"}], f)
    with pytest.raises(Exception, match="14"):
        io.reference_json(spark, str(tmp_path / "bad.json")).collect()


def test_labelled_requests(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"entries":[{"request":' + REQ + ',"expected_approved":true}]}')
    row = io.labelled_requests(spark, str(tmp_path / "t.json")).select(features.vector().alias("v"), "expected").first()
    assert row.expected and row.v == expected(BODY)
