"""Every index against brute force, on random integer vectors with ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnspark.constants import DIMS
from knnspark.functions import features
from knnspark.operators import blocks, cells, evaluate, index, ivf, knn, partitioned
from knnspark.sources import io


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        v = [rng.choice([0, 2500, 5000, 10000]) for _ in range(DIMS)]
        if i % 5 == 0:
            v[5] = v[6] = -10000
        rows.append((i, v, rng.randint(0, 1)))
    ref = spark.createDataFrame(rows, "rid long, v array<int>, label int").withColumn("pkey", features.key8(F.col("v"))).cache()
    q = ref.filter("rid % 20 = 0").select(F.col("rid").alias("qid"), F.col("v").alias("qv"), "pkey")
    want = {}
    for i, v, _ in rows[::20]:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w, _ in rows if j != i)
        want[i] = d[:5]
    return ref, q, want


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rn").collect():
        out.setdefault(r.qid, []).append((r.d, r.rid))
    return out


def test_brute_equals_python(data):
    ref, q, want = data
    assert lists(knn.brute(q, ref, DIMS)) == want


def test_blocks_equal_one_block(data, monkeypatch):
    ref, q, want = data
    monkeypatch.setattr(knn, "BLOCK", 3)
    assert lists(knn.brute(q, ref, DIMS)) == want


def test_partitioned_search_is_exact(data):
    ref, q, want = data
    assert lists(partitioned.search(q, ref, partitioned.boxes(ref, ["pkey"], DIMS), DIMS, ["pkey"])) == want
    tree = partitioned.leaves(ref, DIMS, 8, 3).cache()
    assert lists(partitioned.search(q, tree, partitioned.boxes(tree, ["pkey", "leaf"], DIMS), DIMS, ["pkey", "leaf"])) == want


def test_clustered_search(spark, data, tmp_path):
    ref, q, want = data
    centroids = ivf.train(ref, 8, 2, DIMS)
    assigned = ivf.assign(ref, centroids).cache()
    stats = ivf.statistics(assigned, DIMS)
    assert lists(ivf.search(q, assigned, centroids, DIMS, 8)) == want
    assert lists(ivf.pruned(q, assigned, centroids, stats, DIMS, 2)) == want
    assert lists(ivf.tiered(q, assigned, centroids, DIMS, 8, (0,) * 6, (0,) * 6)) == want
    fast = ivf.search(q, assigned, centroids, DIMS, 1)
    hits = knn.recall(fast, knn.brute(q, ref, DIMS)).first()
    assert 0 < hits.hits <= hits.total == 100
    for r in assigned.join(stats, "cid").collect():
        assert all(a <= x <= b for a, x, b in zip(r.bmin, r.v, r.bmax, strict=True)) and r.cd <= r.radius2
    io.save_index(str(tmp_path / "i"), assigned, centroids, stats, 8)
    members, _, _ = io.load_index(spark, str(tmp_path / "i"))
    assert members.count() == 400


def test_indexes_live_on_disk(spark, data, tmp_path):
    ref, q, want = data
    plain = q.select("qid", "qv")
    index.Partitioned.build(ref, most=8).save(str(tmp_path / "t"))
    tree = index.Partitioned.load(spark, str(tmp_path / "t")).ready(5)
    assert lists(tree.search(plain)) == want and tree.info().first().dataset_count == 400
    assert tree.directory.agg(F.max("n")).first()[0] <= 8
    index.Clustered.build(ref, k=8).save(str(tmp_path / "c"))
    clusters = index.Clustered.load(spark, str(tmp_path / "c")).ready(5)
    assert lists(clusters.search(plain)) == want  # eight probes are all clusters
    assert tuple(clusters.info().first()) == (400, 8) and index.Clustered.build(ref).info().first().k == round(4096 * (400 / 3e6) ** 0.5)
    with pytest.raises(ValueError):
        index.Partitioned.load(spark, str(tmp_path / "c"))


def test_joins_equal_blocks(data, monkeypatch):
    """More queries than may travel are joined; the answers are the same."""
    ref, q, want = data
    monkeypatch.setattr(blocks, "QUERIES", 3)
    centroids = ivf.train(ref, 8, 2, DIMS)
    assigned = ivf.assign(ref, centroids).cache()
    assert lists(ivf.search(q, assigned, centroids, DIMS, 8)) == want
    assert lists(partitioned.search(q, ref, partitioned.boxes(ref, ["pkey"], DIMS), DIMS, ["pkey"])) == want


def compares_rows(df):
    """Whether the plan pairs rows of queries with rows of the table."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow" not in plan or "qid#" in plan and "Join" in plan


@pytest.mark.parametrize("wanted", [1_000_000, 9])
def test_more_queries_than_travel_come_in_blocks(data, monkeypatch, wanted):
    ref, q, want = data
    monkeypatch.setattr(blocks, "QUERIES", 3)
    monkeypatch.setattr(blocks, "WANTED", wanted)
    monkeypatch.setattr(knn, "BLOCK", 3)
    centroids = ivf.train(ref, 8, 2, DIMS)
    assigned = ivf.assign(ref, centroids).cache()
    found = [
        knn.brute(q, ref, DIMS), ivf.search(q, assigned, centroids, DIMS, 8), ivf.pruned(q, assigned, centroids, ivf.statistics(assigned, DIMS), DIMS, 2),
        ivf.tiered(q, assigned, centroids, DIMS, 8, (0,) * 6, (0,) * 6), partitioned.search(q, ref, partitioned.boxes(ref, ["pkey"], DIMS), DIMS, ["pkey"]),
    ]
    for df in found:
        assert not compares_rows(df) and lists(df) == want


def test_rows_within_the_fifth_distance(data, monkeypatch):
    ref, q, want = data
    monkeypatch.setattr(knn, "BLOCK", 7)
    rows = {r.rid: r.v for r in ref.collect()}
    got = {(r.qid, r.rid): r.d for r in knn.within(q, ref, 5, 8).collect()}
    far = {(i, j): sum((a - b) ** 2 for a, b in zip(rows[i], w, strict=True)) for i in want for j, w in rows.items() if i != j}
    assert got == {(i, j): d for (i, j), d in far.items() if d <= want[i][4][0]}
    assert {i for i, _ in got} == set(want) and knn.within(q, ref.filter("rid < 0"), 5, 8).count() == 0


def test_rows_within_the_fifth_distance_lie_in_few_cells(spark, data, monkeypatch):
    """Boxes spare the query of `dist_partial_filter` nearly all pairs; its rows are those of all pairs, ties and copies included."""
    from knnspark.plans import queries

    ref, q, _ = data
    rows = lambda df: sorted(map(tuple, df.select("qid", "rid", "d").collect()))
    copies = ref.unionByName(ref.withColumn("rid", F.col("rid") + 400)).cache()
    asked = copies.filter("rid % 20 = 0").select(F.col("rid").alias("qid"), F.col("v").alias("qv"), "pkey")
    monkeypatch.setattr(cells, "CELL", 100)
    want = rows(knn.within(asked, copies, 5, 8))
    assert rows(partitioned.within(asked, copies, 5, 8)) == want
    monkeypatch.setattr(blocks, "QUERIES", 7)
    assert rows(partitioned.within(asked, copies, 5, 8)) == want
    few = ref.filter("rid < 3")
    assert rows(partitioned.within(q, few, 5, 8)) == rows(knn.within(q, few, 5, 8)) != []
    assert rows(partitioned.within(q, ref.filter("false"), 5, 8)) == rows(partitioned.within(q.filter("false"), ref, 5, 8)) == []

    def compare(*_):
        raise AssertionError("every pair is compared")

    for name in ("nearest", "within"):
        monkeypatch.setattr(blocks, name, compare)
    assert queries.QUERIES["dist_partial_filter"](spark, "/root/testdata/sf0.001").count() > 0


def test_a_distance_meets_few_rows(monkeypatch):
    """Whether or not queries and hits come in parts."""
    monkeypatch.setattr(cells, "PART", 30)
    monkeypatch.setattr(cells, "FEW", 3)
    monkeypatch.setattr(blocks, "HITS", 7)
    rng = np.random.default_rng(6)
    x, rids = rng.integers(-10000, 10001, (20_000, 3)), np.arange(20_000)
    order, pieces = cells._halved(x)
    q = np.arange(0, 20_000, 400)
    far = np.sort(((x[q][:, None] - x[None]) ** 2).sum(2), axis=1)[:, 5]
    asked, met = cells._Asked(q, x[q], far), []
    part = blocks._Distances(x[q][:, :2])
    to = part.to
    part.to = lambda rows: lambda of, a, b: (met.append(len(of) * (b - a)), to(rows)(of, a, b))[1]
    got = [r for b in cells._near(asked, part, 2, np.arange(len(q)), rids[order], x[order], pieces) for r in b.to_pylist()]
    assert 0 < sum(met) < 0.1 * len(q) * len(x)
    d = ((x[q][:, None] - x[None]) ** 2).sum(2)
    assert sorted((r["qid"], r["rid"], r["d"]) for r in got) == sorted((int(q[i]), int(j), int(d[i, j])) for i, j in zip(*np.nonzero(d <= far[:, None]), strict=True) if q[i] != j)


def test_best_of_many_equal_rows():
    """Ties go to the smaller row in whatever order and pieces they come."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (3000, 4)) * 10000
    rids = rng.permutation(3000)
    q = np.arange(0, 3000, 100)
    best = blocks._Best(rids[q], x[q], np.full(len(q), blocks.FAR), 5)
    for at in range(0, 3000, 700):
        best.offer(np.arange(len(q)), rids[at : at + 700], x[at : at + 700], rids[at : at + 700])
    for i, place in enumerate(q):
        d = ((x - x[place]) ** 2).sum(1)
        nearest = [(int(d[j]), int(rids[j])) for j in np.lexsort((rids, d)) if j != place][:5]
        mine = best.held["q"] == i
        assert sorted(zip(best.held["d"][mine].tolist(), best.held["rid"][mine].tolist(), strict=True)) == nearest


def test_squares_of_large_numbers_are_exact():
    a, b = np.array([[2**30, -5], [3, 4]]), np.array([[-(2**30), 7]])
    assert blocks.squares(a, b).tolist() == [[2**62 + 144], [(2**30 + 3) ** 2 + 9]]


def test_spread_seeds(spark, data):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.integers(-9, 10, (50, 3)) for c in ([0, 0, 0], [5000, 0, 0], [0, 5000, 0], [0, 0, 5000])])
    seeds = ivf.spread_seeds(x, 4, np.random.default_rng(2))
    assert len({tuple(np.round(s / 5000).astype(int)) for s in seeds}) == 4  # one in each clump
    assert len(ivf.spread_seeds(np.zeros((3, 2), np.int64), 3, rng)) == 3
    ref, _, _ = data
    inertia = [ivf.assign(ref, ivf.train_sampled(ref, 8, n)).agg(F.sum("cd")).first()[0] for n in (0, 6)]
    assert inertia[1] < inertia[0] and ivf.train_sampled(ref.filter("false"), 8).count() == 0


def test_inertia_falls(data):
    ref, _, _ = data
    at = [ivf.assign(ref, ivf.train(ref, 8, n, DIMS)).agg(F.sum("cd")).first()[0] for n in (0, 3)]
    assert at[1] <= at[0]


def test_fewer_than_five_neighbours_and_empty_tables(spark, data):
    ref, q, _ = data
    few = ref.filter("rid < 3")
    assert all(len(x) <= 3 for x in lists(knn.brute(q, few, DIMS)).values())
    assert knn.brute(q, ref.filter("false"), DIMS).count() == 0
    assert knn.brute(q.filter("false"), ref, DIMS).count() == 0


def test_leaf_sizes(data):
    ref, _, _ = data
    tree = partitioned.leaves(ref, DIMS, 4)
    assert tree.groupBy("pkey", "leaf").count().agg(F.max("count")).first()[0] <= 4
    assert tree.count() == 400


@pytest.mark.parametrize("group", [100_000, 30])
def test_a_tree_of_many_levels_has_a_small_plan(data, monkeypatch, group):
    """Nodes are split level by level or in memory, to the same leaves; the plan doesn't double with each level."""
    ref, _, _ = data
    rows = ref.withColumn("pkey", F.lit(0))
    monkeypatch.setattr(partitioned, "GROUP", group)
    tree = partitioned.leaves(rows, DIMS, 2)
    assert len(tree._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    want, waiting = {}, [(sorted((r.rid, r.v) for r in rows.collect()), "")]
    while waiting:
        of, name = waiting.pop()
        if len(of) <= 2:
            want |= {rid: name for rid, _ in of}
            continue
        spans = [max(v[i] for _, v in of) - min(v[i] for _, v in of) for i in range(DIMS)]
        of.sort(key=lambda r: (r[1][spans.index(max(spans))], r[0]))  # noqa: B023
        waiting += [(of[: len(of) // 2], name + "0"), (of[len(of) // 2 :], name + "1")]
    assert {r.rid: r.leaf for r in tree.select("rid", "leaf").collect()} == want


def test_thresholds_and_breakdown(spark):
    rows = [(0, 100, 3, False), (0, 50, 4, False), (5, 70, 0, True), (3, 9, 1, True), (1, 5, 1, True)]
    r = spark.createDataFrame(rows, "fast_count long, fast_worst long, full_count long, expected boolean")
    assert [x.threshold for x in evaluate.thresholds(r).orderBy("class").collect()] == [49, 0, 0, 0, 0, 69]
    assert [(x.n, x.fast_wrong, x.fixable) for x in evaluate.class_breakdown(r).orderBy("class").collect()] == [(2, 2, 2), (1, 0, 0), (0, 0, 0), (1, 1, 1), (0, 0, 0), (1, 1, 1)]


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x % 97),) for x in range(1000)], "x double")
    want = sorted(x % 97 for x in range(1000))
    got = {r.percent: r.value for r in evaluate.percentile_rows(v, "x", [0, 50, 99]).collect()}
    assert got == {p: want[1000 * p // 100] for p in (0, 50, 99)}


@pytest.fixture
def probed(monkeypatch):
    """The (query, cluster) pairs of each cluster search."""
    seen, search = [], ivf.nearest_of

    def record(probes, *more):
        seen.append([(r.qid, r.cid) for r in probes.select("qid", "cid").collect()])
        return search(probes, *more)

    monkeypatch.setattr(ivf, "nearest_of", record)
    return seen


def once(seen):
    pairs = [p for search in seen for p in search]
    return len(pairs) == len(set(pairs)) > 0


def test_no_cluster_is_searched_twice(data, probed):
    ref, q, want = data
    centroids = ivf.train(ref, 8, 2, DIMS)
    assigned = ivf.assign(ref, centroids).cache()
    assert lists(ivf.tiered(q, assigned, centroids, DIMS, 1, (1,) * 6, (7,) * 6)) == want  # all look at all clusters
    assert len(probed) == 2 and once(probed)
    probed.clear()
    assert lists(ivf.pruned(q, assigned, centroids, ivf.statistics(assigned, DIMS), DIMS, 2)) == want
    assert len(probed) == 2 and once(probed)


def test_sweep_equals_each_setting_alone(data, probed):
    ref, q, want = data
    centroids = ivf.train(ref, 8, 2, DIMS)
    assigned = ivf.assign(ref, centroids).cache()
    tops = ivf.banded(ivf.scores(q, centroids), q, assigned, DIMS, ivf.search(q, assigned, centroids, DIMS, 1), 1, [3, 0, 7])
    assert len(probed) == 3 and once(probed)
    assert lists(tops[7]) == want
    for n in (0, 3):
        assert lists(tops[n]) == lists(ivf.search(q, assigned, centroids, DIMS, 1 + n))


@pytest.mark.parametrize("name", ["calib_class_breakdown", "calib_thresholds", "count_mismatch", "knn_recall_at5", "confusion_matrix"])
def test_exact_neighbours_need_not_compare_all(spark, monkeypatch, name):
    from knnspark.plans import queries

    def compare(*_):
        raise AssertionError("every pair is compared")

    want = sorted(map(tuple, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(knn, "brute", compare)
    assert sorted(map(tuple, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want


def test_recall_counts_what_was_found(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "qid long, rid long")
    assert tuple(knn.recall(rows([(1, 2), (1, 9), (2, 4)]), rows([(1, 2), (1, 3), (2, 4)])).first()) == (2, 3)
    assert tuple(knn.recall(rows([]), rows([])).first()) == (0, 0)


def test_scored_requests_do_not_carry_their_plan(spark):
    from knnspark.plans import queries

    plan = queries.QUERIES["score_partitioned"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "get_json_object" not in plan  # those of the events' table


def test_scoring_makes_its_transactions_once(spark, monkeypatch):
    """Neither the tree's rows nor the requests carry the plan of the events, which is made one time."""
    from knnspark.plans import fixtures, queries

    made, plans, tx, save = [], [], fixtures.tx, index.Partitioned.save
    monkeypatch.setattr(fixtures, "tx", lambda *a: made.append(a) or tx(*a))
    monkeypatch.setattr(index.Partitioned, "save", lambda self, path: plans.append(self.members._jdf.queryExecution().optimizedPlan().toString()) or save(self, path))
    queries.QUERIES["score_partitioned"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "get_json_object" not in plans[0] and "Window" not in plans[0]


def test_a_query_meets_few_rows():
    """Near rows lie in few cells and pieces, so that bounds spare nearly all pairs; what is found is exact."""
    rng = np.random.default_rng(4)
    x, rids, zero = rng.integers(-10000, 10001, (20_000, 3)), np.arange(20_000), np.zeros(20_000, np.int64)
    cuts = cells.Cuts(zero[::10], x[::10], rids[::10], 50)
    cell, q = cuts.of(zero, x, rids), np.arange(0, 20_000, 100)
    q = q[np.argsort(cell[q], kind="stable")]
    starts = np.flatnonzero(np.diff(cell[q], prepend=-1))
    met, rows, bound = [], {}, np.full(len(q), blocks.FAR)

    def best():
        out = blocks._Best(rids[q], x[q], bound, 5)
        offer = out.offer
        out.offer = lambda who, some, *more: (met.append(len(who) * len(some)), offer(who, some, *more))
        return out

    first = best()
    for c in np.unique(cell):
        of = np.flatnonzero(cell == c)
        order, pieces = cells._halved(x[of])
        rows[c] = (rids[of[order]], x[of[order]], zero[of], pieces)
        cells._met(first, np.flatnonzero(cell[q] == c), *rows[c])
    bound = first.bound
    last = best()
    reached = cells._reached(last, starts)
    for c in rows:
        cells._met(last, blocks._within(last, reached(rows[c][1]), rows[c][1]), *rows[c])
    assert max(map(lambda r: len(r[0]), rows.values())) < 2000 and sum(met) < 0.05 * len(q) * len(x)
    for i, place in enumerate(q):
        d = ((x - x[place]) ** 2).sum(1)
        mine = last.held["q"] == i
        assert last.held["rid"][mine].tolist() == [j for j in np.lexsort((rids, d)) if j != place][:5]


def test_equal_rows_lie_in_many_cells(spark, monkeypatch):
    """Neither a partition nor a vector that most rows share is dealt to one task."""
    monkeypatch.setattr(cells, "SAMPLE", 300)
    monkeypatch.setattr(cells, "CELL", 100)
    rows = [(i, [7, i if i % 3 == 0 else 0], i % 2, 0 if i else 9) for i in range(3000)]
    ref = spark.createDataFrame(rows, "rid long, v array<int>, label int, pkey int").cache()
    sizes = [len(r.rids) // 8 for r in cells.packed(ref, ["pkey"])[1].collect()]
    assert sum(sizes) == 3000 and len(sizes) > 10 and max(sizes) < 600
    q = ref.filter("rid % 100 = 0").select(F.col("rid").alias("qid"), F.col("v").alias("qv"), "pkey")
    assert lists(partitioned.search(q, ref, partitioned.boxes(ref, ["pkey"], 2), 2, ["pkey"])) == lists(knn.brute(q, ref, 2))


def test_a_saved_tree_holds_nothing(spark, data, tmp_path):
    """What was held to build the index goes when it is saved; nothing is made anew to be counted."""
    ref, q, want = data
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    ref.count()
    before = held()
    tree = index.Partitioned.build(ref.select("rid", "v", "label"), most=8)
    tree.save(str(tmp_path / "t"))
    assert held() <= before
    assert tree.info().first().dataset_count == 400 and lists(tree.search(q.select("qid", "qv"))) == want
