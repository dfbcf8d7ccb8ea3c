"""A cross-section of the registered queries against DuckDB at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["src_reference_scan", "vectorize14", "partition_key8", "knn5_tx_brute", "knn5_specialist", "knn5_ivf", "kmeans_step", "kdtree_split_level", "calib_thresholds", "latency_percentiles", "win_tx_count_24h", "load_shed", "stub_mode", "stream_score", "dist_partial_filter", "escalate_next_n", "kdtree_leaves", "score_detection", "grid_cell_key", "score_partitioned", "index_info", "run_artifacts", "synthetic_queries", "config_int", "calib_topn_sweep", "calib_perclass_sweep", "knn5_pruned"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    answer = duck.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in answer.description], answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["kdtree_leaves", "leaf_bbox"])
def test_leaves_go_on_where_the_sql_ends(spark, name):
    """The SQL splits four times; with as many levels as leaves of 128 rows need it gives the query's rows, and these hold its own."""
    from knnspark.plans import oracle

    sf, con, levels = "/root/testdata/sf0.1", duckdb.connect(), 7  # 9,960 rows in the largest partition
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    sql = oracle.ORACLE_SQL[name]
    tree = f"WITH {oracle.TREE}"
    assert sql.startswith(tree)
    deeper = ",".join(oracle.split(n) for n in range(oracle.LEVELS + 1, levels + 1))
    more = f"{tree},{deeper}" + sql.removeprefix(tree).replace(f"FROM l{oracle.LEVELS}", f"FROM l{levels}")
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    answer = con.execute(more)
    assert rows(df.columns, got) == rows([d[0] for d in answer.description], answer.fetchall())
    sizes = Counter()
    for r in got:
        sizes[r.pkey, r.leaf] += 1 if name == "kdtree_leaves" else r.n
    assert max(sizes.values()) <= oracle.LEAF
    joined, theirs = Counter(), Counter()
    for (pkey, leaf), n in sizes.items():
        joined[pkey, leaf[: oracle.LEVELS]] += n
    for pkey, leaf, n in con.execute(f"SELECT pkey, leaf, {'count(*)' if name == 'kdtree_leaves' else 'sum(n)'} FROM ({sql}) GROUP BY pkey, leaf").fetchall():
        theirs[pkey, leaf] += n
    assert joined == theirs


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream(spark):
    assert entry.queries()["stream_score"](spark, SF).count() == 50


def test_repeated_requests_are_answered_alike(spark):
    from knnspark.plans import fixtures, queries
    from knnspark.streaming import score

    request = queries.requests(spark, SF).orderBy("event_id").limit(2).selectExpr("CAST(event_id AS STRING) AS id", "request")
    ref = fixtures.vectors(spark, SF)
    once = {r.id: r.fraud_count for r in score.score(request, ref).collect()}
    twice = score.score(request.unionByName(request), ref).collect()
    assert len(twice) == 4 and all(r.fraud_count == once[r.id] for r in twice)
