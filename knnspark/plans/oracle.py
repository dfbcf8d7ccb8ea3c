"""DuckDB SQL that answers each query independently of Spark."""

from knnspark.constants import DIMS, MCC_RISK
from knnspark.functions.decision import ANSWERS
from knnspark.plans.settings import EXTRA, K, LEAF, LEVELS, PROBES, ROUNDS, THRESHOLDS, UNIFORM


def grid(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 10000 ELSE CAST(floor(CAST({x} AS FLOAT) * CAST(10000 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) END)"


def dist(a: str, b: str, n: int = DIMS) -> str:
    return "(" + " + ".join(f"CAST({a}[{i}] - {b}[{i}] AS BIGINT) * CAST({a}[{i}] - {b}[{i}] AS BIGINT)" for i in range(1, n + 1)) + ")"


def box(q: str, low: str, high: str, n: int = DIMS) -> str:
    side = lambda i: f"CAST(greatest(0, {q}[{i}] - {high}[{i}], {low}[{i}] - {q}[{i}]) AS BIGINT)"
    return "(" + " + ".join(f"{side(i)} * {side(i)}" for i in range(1, n + 1)) + ")"


def each(f: str, n: int = DIMS) -> str:
    """A list of an aggregate of every dimension."""
    return "[" + ", ".join(f.format(x=f"v[{i}]") for i in range(1, n + 1)) + "]"


def top(name: str, of: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) rn FROM {of}) WHERE rn <= 5)"


def votes(name: str, of: str) -> str:
    return f"{name} AS (SELECT qid, CAST(sum(label) AS BIGINT) fraud_count, max(d) worst FROM {of} GROUP BY qid)"


def pick(values: tuple) -> str:
    return "CASE fraud_count " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


RISK = "(CASE mcc " + " ".join(f"WHEN '{c}' THEN CAST({r} AS DOUBLE)" for c, r in MCC_RISK.items()) + " ELSE CAST(0.5 AS DOUBLE) END)"
CODES = "[" + ", ".join(f"'{c}'" for c in [*MCC_RISK, "0000"]) + "]"
MINUTE = "CAST(epoch_us({x}) // 60000000 AS BIGINT)"
GAP = f"greatest({MINUTE.format(x='ts')} - {MINUTE.format(x='last_ts')}, 0)"

TX = f"""
ev AS (SELECT event_id, ts, user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) cents, CAST(regexp_extract(props, '[0-9]+') AS INT) k FROM events),
mer AS (SELECT k, CAST(sum(cents) AS BIGINT) ms, count(*) mc FROM ev GROUP BY k),
ew AS (SELECT *, lag(ts) OVER u last_ts, lag(k) OVER u last_k,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev_n,
  CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) prev_cents,
  count(*) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 tx24
  FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
tx AS (SELECT ew.*, cents * 20 / CAST(100 AS DOUBLE) amount, k % 12 + 1 installments,
  CASE WHEN prev_n > 0 THEN prev_cents / prev_n / 100 * 20 ELSE CAST(0 AS DOUBLE) END avg_amount,
  {CODES}[k % 11 + 1] mcc, ms / mc / 100 * 20 merchant_avg,
  event_type IN ('click', 'view') is_online, event_type = 'purchase' card_present, event_id * 37 % 1200 km_home, abs(k - last_k) * 10 km_last,
  CASE WHEN event_type = 'error' OR cents > 12000 THEN 1 ELSE 0 END label
  FROM ew JOIN mer USING (k))"""
RATIO = f"CASE WHEN avg_amount > 0 THEN {grid('(amount / avg_amount / 10)')} ELSE 10000 END"
SINCE = f"CASE WHEN last_ts IS NULL THEN -10000 ELSE {grid(f'({GAP} / 1440)')} END"
KM = f"CASE WHEN last_ts IS NULL THEN -10000 ELSE {grid('(km_last / 1000)')} END"
PARTS = [
    grid("(amount / 10000)"), grid("(installments / 12)"), RATIO, grid("(hour(ts) / 23)"), grid("((isodow(ts) - 1) / 6)"), SINCE, KM,
    grid("(km_home / 1000)"), grid("(tx24 / 20)"), "CASE WHEN is_online THEN 10000 ELSE 0 END", "CASE WHEN card_present THEN 10000 ELSE 0 END",
    "CASE WHEN seen = 0 THEN 10000 ELSE 0 END", grid(RISK), grid("(merchant_avg / 10000)"),
]
BUCKET = "CASE WHEN v[13] <= 2499 THEN 0 WHEN v[13] <= 4999 THEN 1 WHEN v[13] <= 7499 THEN 2 ELSE 3 END"
bits = lambda *c: " + ".join(f"CASE WHEN {x} THEN {1 << n} ELSE 0 END" for x, n in c)
KEY8 = bits(("v[6] <> -10000", 0), ("v[10] > 5000", 1), ("v[11] > 5000", 2), ("v[12] > 5000", 3), ("v[3] > 5000", 6), ("v[9] > 2500", 7)) + f" + ({BUCKET}) * 16"
KEY5 = bits(("v[10] > 5000", 0), ("v[11] > 5000", 1), ("v[12] > 5000", 2), ("v[6] = -10000", 3), ("v[7] = -10000", 4))
VEC = f"""{TX},
v0 AS (SELECT event_id rid, [{", ".join(PARTS)}] v, label FROM tx),
vec AS MATERIALIZED (SELECT rid, v, label, CAST({KEY8} AS INT) pkey FROM v0),
q AS (SELECT rid qid, v qv, label ql, pkey FROM vec WHERE rid % 20 = 0),
ba AS (SELECT qid, rid, {dist("qv", "v")} d, vec.label FROM q JOIN vec ON qid <> rid),
{top("bt", "ba")}, {votes("bv", "bt")}"""


def lloyd(n: int) -> str:
    """Assignment to the centroids of round n-1, and the centroids of round n."""
    p = f"c{n - 1}"
    return f"""
a{n} AS (SELECT rid, min({dist("v", "c")} * {K} + cid) key FROM vec, {p} GROUP BY rid),
m{n} AS (SELECT key % {K} cid, {each("CAST(floor(CAST(sum({x}) AS BIGINT) / count(*) + 0.5) AS INT)")} m FROM a{n} JOIN vec USING (rid) GROUP BY 1),
c{n} AS MATERIALIZED (SELECT {p}.cid, coalesce(m, c) c FROM {p} LEFT JOIN m{n} USING (cid))"""


IVF = f"""{VEC},
c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5(CAST(rid AS VARCHAR)), rid) - 1 AS INT) cid, v c FROM vec QUALIFY cid < {K}),
{",".join(lloyd(n) for n in range(1, ROUNDS + 1))},
ak AS (SELECT rid, min({dist("v", "c")} * {K} + cid) key FROM vec, c{ROUNDS} GROUP BY rid),
asg AS MATERIALIZED (SELECT rid, v, label, CAST(key % {K} AS INT) cid, key // {K} cd FROM ak JOIN vec USING (rid)),
st AS (SELECT cid, count(*) n, {each("min({x})")} bmin, {each("max({x})")} bmax, max(cd) radius2 FROM asg GROUP BY cid),
sc AS MATERIALIZED (SELECT qid, cid, d, row_number() OVER (PARTITION BY qid ORDER BY d, cid) rn FROM (SELECT qid, cid, {dist("qv", "c")} d FROM q, c{ROUNDS})),
fa AS (SELECT qid, rid, {dist("qv", "v")} d, asg.label, sc.rn probe FROM sc JOIN asg USING (cid) JOIN q USING (qid) WHERE rid <> qid AND sc.rn <= {PROBES}),
{top("ft", "fa")}, {votes("fv", "ft")},
gt AS (SELECT qid, fraud_count, worst, fraud_count BETWEEN 2 AND 4 OR ({pick(THRESHOLDS)} > 0 AND worst > {pick(THRESHOLDS)}) escalate FROM fv),
gx AS (SELECT *, CASE WHEN escalate THEN {pick(EXTRA)} ELSE 0 END extra FROM gt),
ua AS (SELECT qid, rid, {dist("qv", "v")} d, asg.label FROM sc JOIN asg USING (cid) JOIN q USING (qid) LEFT JOIN gx USING (qid) WHERE rid <> qid AND sc.rn <= {PROBES} + CASE WHEN coalesce(escalate, false) THEN {UNIFORM} ELSE 0 END),
{top("ut", "ua")}, {votes("uv", "ut")},
ca AS (SELECT qid, rid, {dist("qv", "v")} d, asg.label FROM sc JOIN asg USING (cid) JOIN q USING (qid) LEFT JOIN gx USING (qid) WHERE rid <> qid AND sc.rn <= {PROBES} + coalesce(extra, 0)),
{top("ct", "ca")}, {votes("cv", "ct")},
rec AS (SELECT qid, fv.fraud_count fast_count, fv.worst fast_worst, bv.fraud_count full_count, uv.fraud_count topn_count, ql = 0 expected FROM fv JOIN bv USING (qid) JOIN uv USING (qid) JOIN q USING (qid)),
wr AS (SELECT *, (fast_count <= 2) <> expected fw, (full_count <= 2) <> expected uw FROM rec)"""

LIST = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 10000 + 0.5) AS INT))"
V64 = f"""
e64 AS MATERIALIZED (SELECT vec_id rid, {LIST} v, CASE WHEN label < 3 THEN 1 ELSE 0 END label FROM embeddings),
ea AS (SELECT a.rid qid, b.rid, {dist("a.v", "b.v", 64)} d, b.label FROM e64 a JOIN e64 b ON a.rid <> b.rid WHERE a.rid % 20 = 0),
{top("et", "ea")}, {votes("evt", "et")}"""


def split(n: int) -> str:
    p = f"l{n - 1}"
    spans = ", ".join(f"max(v[{i}]) - min(v[{i}])" for i in range(1, DIMS + 1))
    return f"""
w{n} AS (SELECT pkey, leaf, count(*) n, [{spans}] s FROM {p} GROUP BY ALL),
x{n} AS (SELECT pkey, leaf, n, list_position(s, list_max(s)) dim FROM w{n}),
l{n} AS MATERIALIZED (SELECT rid, v, label, pkey, leaf || CASE WHEN n <= {LEAF} THEN '' WHEN row_number() OVER (PARTITION BY pkey, leaf ORDER BY v[dim], rid) <= n // 2 THEN '0' ELSE '1' END leaf FROM {p} JOIN x{n} USING (pkey, leaf))"""


TREE = f"{VEC}, l0 AS (SELECT *, '' leaf FROM vec), {','.join(split(n) for n in range(1, LEVELS + 1))}"
PART = f"{VEC}, pst AS (SELECT pkey, count(*) n, {each('min({x})')} bmin, {each('max({x})')} bmax FROM vec GROUP BY pkey)"
LAT = "lt AS (SELECT l_extendedprice v, row_number() OVER (ORDER BY l_extendedprice) - 1 i, count(*) OVER () n FROM lineitem)"
OUT = "qid, rid, d, label, rn"
NUMBERS = "CASE k % 6 WHEN 0 THEN '1e3' WHEN 1 THEN '-12.5' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(cents AS VARCHAR) WHEN 4 THEN '' ELSE '0.125' END"
BAD = "event_id % 10 = 7"

ORACLE_SQL = {
    "src_reference_scan": f"WITH {V64} SELECT rid, array_to_string(v, ',') v, label FROM e64",
    "src_arity_check": "SELECT count(*) FILTER (len(embedding) = 64) good, count(*) FILTER (coalesce(len(embedding), 0) <> 64) bad FROM embeddings",
    "label_decode": "SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 0 END label FROM embeddings",
    "idx_roundtrip": f"WITH {IVF} SELECT rid, array_to_string(v, ',') v, label, cid, cd FROM asg",
    "src_explode_entries": f"WITH {TX} SELECT event_id, amount, label = 0 expected FROM tx",
    "debug_info": f"WITH {IVF} SELECT count(*) dataset_count, count(DISTINCT cid) k FROM asg",
    "vectorize14": f"WITH {VEC} SELECT rid, array_to_string(v, ',') v, label FROM vec",
    "parse_number": f"WITH {TX} SELECT event_id, TRY_CAST({NUMBERS} AS DOUBLE) number FROM ev",
    "quantize_clamp": f"SELECT event_id, {grid('(value / 100 - 0.1::DOUBLE)')} q FROM events",
    "quantize_sentinel": f"SELECT event_id, CASE WHEN abs(x + 1) <= 1e-6::DOUBLE THEN -10000 ELSE {grid('x')} END q FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE value / 100 END x FROM events)",
    "feat_amount_vs_avg": f"WITH {TX} SELECT event_id, {RATIO} q FROM tx",
    "feat_day_number": "SELECT event_id, date_diff('day', DATE '0001-01-01', CAST(ts AS DATE)) day_number FROM events",
    "feat_hour_dow": f"SELECT event_id, {grid('(hour(ts) / 23)')} hour_q, {grid('((isodow(ts) - 1) / 6)')} dow_q FROM events",
    "feat_minutes_since_last": f"WITH {TX} SELECT event_id, {SINCE} q FROM tx",
    "feat_last_tx_sentinel": f"WITH {TX} SELECT event_id, {SINCE} q5, {KM} q6 FROM tx",
    "feat_bools": f"WITH {TX} SELECT event_id, {PARTS[9]} online_q, {PARTS[10]} present_q FROM tx",
    "feat_unknown_merchant": f"WITH {TX} SELECT event_id, {PARTS[11]} q FROM tx",
    "feat_mcc_risk": f"WITH {TX} SELECT event_id, mcc, {grid(RISK)} q FROM tx",
    "partition_key8": f"WITH {VEC} SELECT rid, pkey FROM vec",
    "partition_key5": f"WITH {VEC} SELECT rid, CAST({KEY5} AS INT) key FROM vec",
    "bucket_mcc": f"WITH {VEC} SELECT rid, CAST({BUCKET} AS INT) bucket FROM vec",
    "grid_cell_key": f"""WITH {VEC}, k5 AS (SELECT rid, v, CAST({KEY5} AS INT) key FROM vec), cuts AS (SELECT key,
  [{", ".join(f"quantile_disc(v[1], CAST({i / 16} AS DOUBLE))" for i in range(1, 16))}] a, [{", ".join(f"quantile_disc(v[13], CAST({i / 8} AS DOUBLE))" for i in range(1, 8))}] b, [{", ".join(f"quantile_disc(v[7], CAST({i / 8} AS DOUBLE))" for i in range(1, 8))}] c FROM k5 GROUP BY key)
SELECT rid, key, CAST(len(list_filter(a, lambda x: x < v[1])) * 64 + len(list_filter(b, lambda x: x < v[13])) * 8 + len(list_filter(c, lambda x: x < v[7])) AS INT) cell FROM k5 JOIN cuts USING (key)""",
    "dist_l2sq": f"WITH {V64} SELECT qid, rid, d FROM ea",
    "dist_partial_filter": f"WITH {VEC} SELECT ba.qid, ba.rid, ba.d FROM ba JOIN bv USING (qid) WHERE ba.d <= worst",
    "aabb_lower_bound": f"WITH {PART} SELECT qid, pst.pkey, {box('qv', 'bmin', 'bmax')} lb FROM q, pst",
    "radius_lower_bound": f"WITH {IVF} SELECT qid, cid, round(pow(greatest(sqrt(CAST(d AS DOUBLE)) - sqrt(CAST(radius2 AS DOUBLE)), 0), 2), 3) lb FROM sc JOIN st USING (cid)",
    "score_decision": f"WITH {VEC} SELECT qid, fraud_count, CAST(fraud_count / 5 AS DOUBLE) fraud_score, fraud_count <= 2 approved FROM bv",
    "render_response": f"WITH {VEC} SELECT qid, CASE fraud_count " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ANSWERS)) + " END response FROM bv",
    "score_p99": "SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(x, 1)) END, 6) score FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 20 x FROM lineitem)",
    "score_detection": "SELECT fp, fn, n, round(CASE WHEN (fp + fn) / n > CAST(0.15 AS DOUBLE) THEN -3000 ELSE 1000 * log10(1 / greatest((fp + 3 * fn) / n, CAST(0.001 AS DOUBLE))) - 300 * log10(1 + fp + 3 * fn) END, 6) score FROM (SELECT count(*) FILTER (quality = 0 AND toxic = 1) fp, count(*) FILTER (quality = 1 AND toxic = 0) // 400 fn, count(*) n FROM labels)",
    "knn5_brute": f"WITH {V64} SELECT {OUT} FROM et",
    "fraud_count": f"WITH {V64} SELECT qid, fraud_count FROM evt",
    "worst_of_top5": f"WITH {V64} SELECT qid, worst FROM evt",
    "knn5_tx_brute": f"WITH {VEC} SELECT {OUT} FROM bt",
    "knn5_pruned": f"WITH {VEC} SELECT {OUT} FROM bt",
    "knn5_specialist": f"WITH {VEC} SELECT {OUT} FROM bt",
    "knn5_kdtree": f"WITH {VEC} SELECT {OUT} FROM bt",
    "knn5_ivf_fast": f"WITH {IVF} SELECT {OUT} FROM ft",
    "knn5_ivf_full": f"WITH {VEC} SELECT {OUT} FROM bt",
    "knn5_ivf_topn": f"WITH {IVF} SELECT {OUT} FROM ut",
    "knn5_ivf": f"WITH {IVF} SELECT {OUT} FROM ct",
    "knn5_ivf_byclass": f"WITH {IVF} SELECT qid, fraud_count, worst FROM cv",
    "escalation_gate": f"WITH {IVF} SELECT qid, fraud_count, worst, escalate, extra FROM gx",
    "escalate_next_n": f"WITH {IVF} SELECT qid, cid, sc.rn FROM sc JOIN gx USING (qid) WHERE sc.rn BETWEEN {PROBES + 1} AND {PROBES} + extra",
    "part_lookup": f"WITH {PART} SELECT qid, pkey, coalesce(n, -1) n FROM q LEFT JOIN (SELECT pkey, n FROM pst WHERE n >= 100) USING (pkey)",
    "known_merchant_semi": f"WITH {TX} SELECT event_id FROM ev a WHERE EXISTS (SELECT 1 FROM ev b WHERE a.user_id = b.user_id AND a.k = b.k AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)))",
    "unknown_merchant_anti": f"WITH {TX} SELECT event_id FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE a.user_id = b.user_id AND a.k = b.k AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)))",
    "confusion_matrix": f"WITH {VEC} SELECT count(*) FILTER (a AND e) tn, count(*) FILTER (NOT a AND NOT e) tp, count(*) FILTER (NOT a AND e) fp, count(*) FILTER (a AND NOT e) fn, count(*) n FROM (SELECT fraud_count <= 2 a, ql = 0 e FROM bv JOIN q USING (qid))",
    "centroid_scores": f"WITH {IVF} SELECT qid, cid, d FROM sc",
    "topn_centroids": f"WITH {IVF} SELECT qid, cid, d, rn FROM sc WHERE rn <= 8",
    "argmin_centroid": f"WITH {IVF} SELECT qid, cid FROM sc WHERE rn = 1",
    "cluster_sizes": f"WITH {IVF} SELECT cid, n FROM st",
    "cluster_offsets": f"WITH {IVF} SELECT cid, CAST(sum(n) OVER (ORDER BY cid) - n AS BIGINT) start FROM st",
    "cluster_bbox": f"WITH {IVF} SELECT cid, array_to_string(bmin, ',') bmin, array_to_string(bmax, ',') bmax FROM st",
    "cluster_radius": f"WITH {IVF} SELECT cid, round(sqrt(CAST(radius2 AS DOUBLE)), 6) radius FROM st",
    "kmeans_step": f"WITH {IVF} SELECT cid, array_to_string(c, ',') c FROM c1",
    "kmeans_assign": f"WITH {IVF} SELECT rid, cid, cd FROM asg",
    "kmeans_inertia": f"WITH {IVF} SELECT CAST(sum(cd) AS BIGINT) inertia FROM asg",
    "kmeans_train": f"WITH {IVF} SELECT cid, array_to_string(c, ',') c FROM c{ROUNDS}",
    "label_counts": f"WITH {TX} SELECT label, count(*) n FROM tx GROUP BY label",
    "calib_class_breakdown": f"WITH {IVF} SELECT c.range AS \"class\", count(fast_count) n, count(*) FILTER (fw) fast_wrong, count(*) FILTER (uw) full_wrong, count(*) FILTER (fw AND NOT uw) fixable FROM range(6) c LEFT JOIN wr ON fast_count = c.range GROUP BY 1",
    "calib_thresholds": f"WITH {IVF} SELECT c.range AS \"class\", CASE WHEN c.range BETWEEN 2 AND 4 THEN 0 ELSE coalesce(min(fast_worst) - 1, 0) END threshold FROM range(6) c LEFT JOIN (SELECT * FROM wr WHERE fw AND NOT uw) ON fast_count = c.range GROUP BY 1",
    "calib_escalation_rate": f"WITH {IVF} SELECT count(*) FILTER (escalate) escalated, count(*) n, round(count(*) FILTER (escalate) / count(*), 6) rate FROM gx",
    "calib_topn_sweep": f"""WITH {IVF}, sw AS (SELECT unnest([0, 2, 4, 8]) extra_n), sa AS (SELECT extra_n, qid, rid, {dist("qv", "v")} d, asg.label FROM sw, sc JOIN asg USING (cid) JOIN q USING (qid) JOIN gt USING (qid) WHERE rid <> qid AND sc.rn <= {PROBES} + CASE WHEN escalate THEN extra_n ELSE 0 END),
sp AS (SELECT *, row_number() OVER (PARTITION BY extra_n, qid ORDER BY d, rid) rn FROM sa), sv AS (SELECT extra_n, qid, sum(label) c FROM sp WHERE rn <= 5 GROUP BY ALL)
SELECT extra_n, count(*) FILTER (c > 2 AND ql = 0) fp, count(*) FILTER (c <= 2 AND ql = 1) fn FROM sv JOIN q USING (qid) GROUP BY extra_n""",
    "calib_perclass_sweep": f"""WITH {IVF}, sw AS (SELECT unnest([0, 2, 4, 8]) extra_n), sa AS (SELECT extra_n, qid, fraud_count fast_count, rid, {dist("qv", "v")} d, asg.label FROM sw, sc JOIN asg USING (cid) JOIN q USING (qid) JOIN gt USING (qid) WHERE rid <> qid AND sc.rn <= {PROBES} + extra_n),
sp AS (SELECT *, row_number() OVER (PARTITION BY extra_n, qid ORDER BY d, rid) rn FROM sa), sv AS (SELECT extra_n, qid, fast_count, sum(label) c FROM sp WHERE rn <= 5 GROUP BY ALL)
SELECT extra_n, fast_count, count(*) FILTER (c > 2 AND ql = 0) fp, count(*) FILTER (c <= 2 AND ql = 1) fn FROM sv JOIN q USING (qid) GROUP BY extra_n, fast_count""",
    "latency_percentiles": f"WITH {LAT} SELECT p.percent, max(v) AS \"value\" FROM lt JOIN (SELECT unnest([50, 90, 99]) percent) p ON i = n * p.percent // 100 GROUP BY p.percent",
    "run_medians": "SELECT user_id, list_sort(list(value))[(count(*) + 1) // 2] median, count(*) n FROM events GROUP BY user_id",
    "leaf_bbox": f"WITH {TREE} SELECT pkey, leaf, count(*) n, array_to_string({each('min({x})')}, ',') bmin, array_to_string({each('max({x})')}, ',') bmax FROM l{LEVELS} GROUP BY pkey, leaf",
    "partition_counts": f"WITH {PART} SELECT pkey, n FROM pst",
    "cluster_member_rank": f"WITH {IVF} SELECT rid, cid, row_number() OVER (PARTITION BY cid ORDER BY cd, rid) place FROM asg",
    "partition_lb_rank": f"WITH {PART} SELECT qid, pst.pkey, rank() OVER (PARTITION BY qid ORDER BY {box('qv', 'bmin', 'bmax')}, pst.pkey) place FROM q, pst",
    "kdtree_split_level": f"WITH {TREE} SELECT rid, pkey, leaf FROM l1",
    "kdtree_leaves": f"WITH {TREE} SELECT rid, pkey, leaf FROM l{LEVELS}",
    "check_first20": f"WITH {VEC} SELECT qid, fraud_count FROM bv ORDER BY qid LIMIT 20",
    "sample_stride": f"WITH {VEC} SELECT rid, label FROM vec WHERE rid % 20 = 0",
    "sample_hash": "SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100",
    "win_lag_last_tx": f"WITH {TX} SELECT event_id, coalesce({MINUTE.format(x='last_ts')}, -1) last_minute, coalesce(last_k, -1) last_k FROM ew",
    "win_tx_count_24h": f"WITH {TX} SELECT event_id, tx24 FROM ew",
    "win_running_avg": f"WITH {TX} SELECT event_id, prev_n, prev_cents, round(avg_amount, 6) avg_amount FROM tx",
    "win_seen_merchant": f"WITH {TX} SELECT event_id, seen FROM ew",
    "scanned_union": f"WITH {IVF} SELECT qid, cid FROM sc WHERE rn <= {PROBES} UNION SELECT qid, cid FROM sc JOIN gx USING (qid) WHERE sc.rn <= {PROBES} + extra",
    "unscanned_except": f"WITH {IVF} SELECT qid, cid FROM sc EXCEPT SELECT qid, cid FROM sc WHERE rn <= {PROBES}",
    "knn_recall_at5": f"WITH {IVF} SELECT count(ft.rid) hits, count(*) total FROM bt LEFT JOIN ft USING (qid, rid)",
    "count_mismatch": f"WITH {IVF} SELECT count(*) FILTER (fv.fraud_count <> bv.fraud_count) mismatches, count(*) n FROM bv JOIN fv USING (qid)",
    "parse_failures": f"SELECT count(*) FILTER ({BAD}) failed, count(*) FILTER (NOT ({BAD})) parsed FROM events",
    "load_shed": "SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) > 4 shed FROM events",
    "stream_score": f"WITH {VEC}, sa AS (SELECT qid, rid, label, {dist('qv', 'v')} d FROM q, vec), sr AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY d, rid) rn FROM sa), sv AS (SELECT qid, CAST(sum(label) AS BIGINT) fraud_count FROM sr WHERE rn <= 5 GROUP BY qid) SELECT CAST(qid AS VARCHAR) id, fraud_count, CAST(fraud_count / 5 AS DOUBLE) fraud_score, fraud_count <= 2 approved FROM sv",
    "stub_mode": "SELECT CAST(event_id AS VARCHAR) id, CAST(0 AS BIGINT) fraud_count, true approved FROM events",
    "index_info": "SELECT count(*) dataset_count FROM events",
    "run_artifacts": f"WITH {TX} SELECT label, count(*) n FROM tx GROUP BY label",
    "synthetic_queries": "SELECT range qid, array_to_string([CAST(CAST('0x' || substr(md5(range || ':' || i), 1, 8) AS BIGINT) % 20000 - 10000 AS INT) FOR i IN range(14)], ',') qv FROM range(1000)",
    "config_int": f"WITH {TX}, st AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN CAST(k - 20 AS VARCHAR) WHEN 3 THEN '1.5' ELSE CAST(cents AS VARCHAR) END s FROM ev) SELECT event_id, CASE WHEN regexp_matches(s, '^[+-]?[0-9]+$') AND TRY_CAST(s AS BIGINT) >= 1 THEN CAST(s AS BIGINT) ELSE 8 END setting FROM st",
}
ORACLE_SQL["score_partitioned"] = ORACLE_SQL["stream_score"]
