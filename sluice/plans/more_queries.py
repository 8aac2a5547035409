"""Queries of panes, stores, rule modes, polluters, sources and helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import scalars as SC
from ..functions.assess import assess
from ..operators import dc, lifecycle as L, pollute as P, quality as QL, streams as S
from ..operators.monitor import Monitor, TaskRegistry, session, tumbling
from ..sources import tables as T
from .dc_queries import RULES, events, lineitem, orders
from .dc_rules import group_rules, parse_index_json, parse_side_json, parse_text, rule
from .monitor_queries import DAY, _ntz

Q: dict = {}
SQL: dict[str, str] = {}


def add(name, sql):
    def keep(f):
        Q[name] = f
        SQL[name] = sql
        return f

    return keep


# ---- windows, instances, assessments --------------------------------------------
_SESSIONS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM l),
    f AS (SELECT user_id, no, event_type, count(*) AS n FROM g GROUP BY ALL),
    t AS (SELECT user_id, no, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, avg(value) AS mean FROM g GROUP BY ALL),
    a AS (SELECT user_id, no, count_if(value > mean) AS above FROM g JOIN t USING (user_id, no) GROUP BY ALL)"""


@add("measures_session_staged", f"""{_SESSIONS}
    SELECT window_start, window_end, user_id, count_if(n = 1) AS u, max(n) AS top, any_value(above) AS above
    FROM f JOIN t USING (user_id, no) JOIN a USING (user_id, no) GROUP BY ALL""")  # fmt: skip
def _session_staged(spark, d):
    m = Monitor("ts", session("6 hours"), "user_id").check(M.unique_count("event_type"), None, "u")
    m.check(M.constancy("event_type"), None, "top").check(M.above_mean_count("value"), None, "above")
    return _ntz(m.run(events(spark, d)))


@add("measures_null_instance", f"""WITH e AS (SELECT *, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS who FROM events),
    f AS (SELECT {DAY}, who, event_type, count(*) AS c FROM e GROUP BY ALL)
    SELECT window_start, window_end, who, sum(c) AS n, count_if(c = 1) AS u FROM f GROUP BY ALL""")  # fmt: skip
def _null_instance(spark, d):
    e = events(spark, d).withColumn("who", F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5))
    return _ntz(Monitor("ts", tumbling("1 day"), "who").add(M.count(), None, "n").add(M.unique_count("event_type"), None, "u").run(e))


@add("assess_function", f"SELECT {DAY}, event_type, count(*) AS n, count(*) % 2 = 0 AS n_ok, max(value) AS hi, true AS hi_ok FROM events GROUP BY ALL")
def _assess_function(spark, d):
    m = Monitor("ts", tumbling("1 day"), "event_type").check(M.count(), lambda c: c % 2 == 0, "n").check(M.max("value"), assess("no assessment", lenient=True), "hi")
    return _ntz(m.run(events(spark, d)))


@add("task_registry", f"SELECT 'daily' AS task, count(*) AS n FROM (SELECT DISTINCT {DAY} FROM events) UNION ALL SELECT 'task_1', count(*) FROM (SELECT DISTINCT {DAY}, event_type FROM events)")
def _registry(spark, d):
    tasks, out = TaskRegistry(), []
    tasks.new(Monitor("ts", tumbling("1 day")).check(M.count()), events(spark, d), "daily")
    tasks.new(Monitor("ts", tumbling("1 day"), "event_type").check(M.count()), events(spark, d))
    tasks.watch_out(lambda name, df: out.append(df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("task"), "n")))
    return out[0].union(out[1])


@add("custom_reducer", "SELECT event_type, round(sum(value * value), 4) AS energy FROM events GROUP BY ALL")
def _reducer(spark, d):
    class Energy(L.Accumulator):
        def zero(self):
            return F.lit(0.0)

        def update(self, state, value):
            return state + F.coalesce(value * value, F.lit(0.0))

    return events(spark, d).groupBy("event_type").agg(F.round(Energy().over("value", "ts"), 4).alias("energy"))


# ---- rules --------------------------------------------------------------------------
@add("dq_type_rule", "SELECT event_id, 'pass' AS whole, CASE WHEN event_type IS NULL THEN 'pass' ELSE 'fail' END AS word, 'skip' AS none FROM events")
def _types(spark, d):
    checks = [QL.Check("whole", "type", "user_id", type="bigint"), QL.Check("word", "type", "event_type", type="bigint"), QL.Check("none", "type", "value")]
    return QL.check_records(events(spark, d), checks).select("event_id", "whole", "word", "none")


_MODE = "o_custkey = o_custkey, o_totalprice > o_totalprice, o_orderpriority = o_orderpriority"


def _mode(name, sql_on):
    Q[f"dc_mode_{name}"] = lambda spark, d: dc.violations(orders(spark, d), rule(_MODE).mode(name), "o_orderkey")
    SQL[f"dc_mode_{name}"] = f"SELECT s.o_orderkey AS s_id, t.o_orderkey AS t_id FROM orders s JOIN orders t ON {sql_on} AND s.o_orderkey <> t.o_orderkey"


_mode("violation", "s.o_custkey = t.o_custkey AND s.o_totalprice > t.o_totalprice AND s.o_orderpriority = t.o_orderpriority")
_mode("inverted_inequalities", "s.o_custkey = t.o_custkey AND s.o_totalprice <= t.o_totalprice AND s.o_orderpriority = t.o_orderpriority")


@add("dc_mode_inverted_all", "SELECT (SELECT count(*) FROM nation s JOIN nation t ON s.n_regionkey <> t.n_regionkey AND s.n_nationkey <= t.n_nationkey) AS violations")
def _inverted_all(spark, d):
    return dc.count(spark.read.parquet(f"{d}/nation.parquet"), rule("n_regionkey = n_regionkey, n_nationkey > n_nationkey").mode("inverted_all"))


@add("dc_decomposed", "SELECT count(*) AS violations FROM orders s JOIN orders t ON s.o_custkey = t.o_custkey AND s.o_orderstatus <> t.o_orderstatus")
def _decomposed(spark, d):
    parts = [dc.count(orders(spark, d), r) for r in rule("o_custkey = o_custkey, o_orderstatus <> o_orderstatus").decomposed()]
    return parts[0].union(parts[1]).agg(F.sum("violations").alias("violations"))


@add("dc_single_index", SQL["dc_mode_violation"])
def _single(spark, d):
    return L.single_index(orders(spark, d), rule(_MODE), "o_orderkey")


_CONFIGS = "SELECT * FROM (VALUES ('index', 0, 'o_custkey = o_custkey, o_totalprice > o_totalprice'), ('side', 1, 'a = a, b < b'), ('text', 2, 'Category = Category, ID <= Amount')) v(kind, discarded, predicates)"


@add("dc_configs", _CONFIGS.replace("'side', 1", "'side', 0").replace("'text', 2", "'text', 1"))
def _configs(spark, d):
    shown = lambda r: ", ".join(f"{p.left} {p.op} {p.right}" for p in r.predicates)
    index = parse_index_json('[[{"colIdx1": 1, "colIdx2": 1, "op": "EQUAL"}, {"colIdx1": 3, "colIdx2": 3, "op": "GREATER"}]]', orders(spark, d).columns)[0]
    side = parse_side_json([{"id": "x", "predicates": [{"left": "a_s", "operator": "=", "right": "a_t"}, {"left": "b_s", "operator": "<", "right": "b_t"}]}])[0]
    text, bad = parse_text("Category = Category\nID <= Amount\nno predicate")
    return spark.createDataFrame([("index", 0, shown(index)), ("side", 0, shown(side)), ("text", len(bad), shown(text))], "kind string, discarded int, predicates string")


SQL["rule_groups"] = "SELECT * FROM (VALUES (0, 'o_custkey,o_orderpriority', 'price,late', 'o_orderdate,o_totalprice'), (1, 'o_custkey', 'status', 'o_totalprice')) v(group_id, keys, rules, dims)"

for _v in ("full", "single_tree", "nl_stream"):
    Q[f"ablation_{_v}"] = lambda spark, d, v=_v: L.variant(orders(spark, d), RULES, "o_orderkey", v).groupBy("dc_id").agg(F.count("*").alias("violations"))
    SQL[f"ablation_{_v}"] = """SELECT dc_id, count(*) AS violations FROM (
        SELECT unnest([CASE WHEN s.o_totalprice > t.o_totalprice AND s.o_orderpriority = t.o_orderpriority THEN 'price' END,
            CASE WHEN s.o_orderpriority = t.o_orderpriority AND s.o_orderdate < t.o_orderdate AND s.o_totalprice > t.o_totalprice THEN 'late' END,
            CASE WHEN s.o_orderstatus <> t.o_orderstatus AND s.o_totalprice < t.o_totalprice THEN 'status' END]) AS dc_id
        FROM orders s JOIN orders t ON s.o_custkey = t.o_custkey AND s.o_orderkey <> t.o_orderkey) WHERE dc_id IS NOT NULL GROUP BY ALL"""


@add("ids_below", "SELECT q AS price, (SELECT count(*) FROM lineitem WHERE l_extendedprice < q) AS n FROM (VALUES (1000.0::DOUBLE), (20000), (55555.5), (1e9)) v(q)")
def _below(spark, d):
    q = spark.createDataFrame([(1000.0,), (20000.0,), (55555.5,), (1e9,)], "price double")
    return L.ids_below(lineitem(spark, d), "l_extendedprice", "id", q, "price")


# ---- boxes and points -----------------------------------------------------------------
@add("points_within", "SELECT p_partkey FROM part WHERE sqrt((p_size - 20) ** 2 + (p_retailprice - 1000) ** 2) <= 40")
def _within(spark, d):
    return dc.within(spark.read.parquet(f"{d}/part.parquet"), [20, 1000], 40, ["p_size", "p_retailprice"]).select("p_partkey")


@add("points_hamming", "SELECT s_suppkey FROM supplier WHERE cast(s_nationkey <> 3 AS INT) + cast(s_acctbal <> 0 AS INT) <= 1")
def _hamming(spark, d):
    return dc.within(spark.read.parquet(f"{d}/supplier.parquet"), [3, 0.0], 1, ["s_nationkey", "s_acctbal"], "hamming").select("s_suppkey")


@add("nearest_accepted", "SELECT p_partkey, round(sqrt((p_size - 20) ** 2 + (p_retailprice - 1000) ** 2), 6) AS distance FROM part WHERE p_size > 25 ORDER BY distance, p_partkey LIMIT 10")
def _accepted(spark, d):
    return dc.nearest(spark.read.parquet(f"{d}/part.parquet"), [20.0, 1000.0], 10, ["p_size", "p_retailprice"], "p_partkey", F.col("p_size") > 25)


@add("points_edited", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 3 <> 2")
def _edited(spark, d):
    points = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal")
    moved = points.where("s_suppkey % 3 > 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 1, F.lit(0.0)))
    return dc.edit(points, moved, "s_suppkey")


@add("boxes_meet", "SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT p_brand, min(p_size) lo, max(p_size) hi FROM part WHERE p_retailprice < 950 GROUP BY ALL) a JOIN (SELECT p_brand, min(p_size) lo, max(p_size) hi FROM part WHERE p_retailprice >= 950 GROUP BY ALL) b ON a.lo <= b.hi AND b.lo <= a.hi")
def _meet(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    box = lambda x: x.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    a, b = box(p.where("p_retailprice < 950")).alias("a"), box(p.where("p_retailprice >= 950")).alias("b")
    on = dc.boxes_meet({"p_size": (F.col("a.lo"), F.col("a.hi"))}, {"p_size": (F.col("b.lo"), F.col("b.hi"))})
    # a row for each of the brands, of which there is a fixed list
    return a.join(F.broadcast(b), on).select(F.col("a.p_brand").alias("a"), F.col("b.p_brand").alias("b"))


# ---- panes and stores ------------------------------------------------------------------
WM = 1705276800000  # 2024-01-15
_END = "(epoch_ms(ts) // 3600000) * 3600000 + 3600000"


def _panes(spark, d):
    return S.assign_panes(events(spark, d), "ts", 3600, 3600).withColumn("pane_end", F.col("pane_start_ms") + 3600000)


@add("pane_states", f"SELECT pane_end, events, CASE WHEN pane_end + 600000 <= {WM} THEN 'evicted' WHEN events >= 4 THEN 'closed' ELSE 'open' END AS state FROM (SELECT {_END} AS pane_end, count(*) AS events FROM events GROUP BY ALL)")
def _states(spark, d):
    return L.pane_states(_panes(spark, d), "pane_end", WM, 600000, 4)


@add("pane_evict", f"SELECT event_id FROM events WHERE {_END} + 600000 > {WM}")
def _evict(spark, d):
    return L.evict(_panes(spark, d), "pane_end", WM, 600000).select("event_id")


@add("ema_stale_reset", """WITH l AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN ts > p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT event_id FROM r QUALIFY run = max(run) OVER (PARTITION BY user_id)""")  # fmt: skip
def _stale(spark, d):
    return L.fresh_only(events(spark, d), "user_id", "ts", 43200, "event_id").select("event_id")


@add("active_boxes", "SELECT * FROM (VALUES (0, 'o_totalprice', 0.0 - 12, 500000.0 + 12), (1, 'o_totalprice', 0.0 - 12, 500000.0 + 12), (0, 'o_orderdate', 0.0 - 2.5, 10.0 + 2.5)) v(group_id, feature, lo, hi)")
def _active(spark, d):
    state = spark.createDataFrame([("o_totalprice", 16.0, 100), ("o_orderdate", 16.0, 3)], "feature string, variance double, n long")
    return L.active_boxes(state, group_rules(RULES), {"o_totalprice": (0.0, 500000.0), "o_orderdate": (0.0, 10.0)}, 3.0, 2.5, 50.0, 30)


def _store(spark, d):
    e = events(spark, d).where("value > 90")
    rows = lambda x: x.select(F.concat(F.lit("a"), F.col("event_id")).alias("alert_id"), F.col("event_type").alias("dc_id"), F.col("user_id").cast("string").alias("window_id"), F.lit("provisional").alias("status"))
    store = L.AlertStore(rows(e.where("event_id % 2 = 0"))).add(rows(e))
    store = store.update(rows(e.where("event_id % 3 = 0")).withColumn("status", F.lit("final")))
    return store.remove(rows(e.where("event_id % 5 = 0")))


_STORE = "(SELECT 'a' || event_id AS alert_id, event_type AS dc_id, cast(user_id AS VARCHAR) AS window_id, CASE WHEN event_id % 3 = 0 THEN 'final' ELSE 'provisional' END AS status FROM events WHERE value > 90 AND event_id % 5 <> 0)"


@add("alert_store", f"SELECT * FROM {_STORE}")
def _alerts(spark, d):
    return _store(spark, d).alerts


@add("alert_counts", f"SELECT dc_id, status, count(*) AS n FROM {_STORE} GROUP BY ALL")
def _alert_counts(spark, d):
    return _store(spark, d).counts()


@add("alert_by_rule", f"SELECT alert_id FROM {_STORE} WHERE dc_id = 'click'")
def _by_rule(spark, d):
    return _store(spark, d).of_rule("click").select("alert_id")


@add("event_lookup", f"SELECT event_id, 'p_' || ({_END} - 3600000) || '_' || {_END} AS pane_id FROM events WHERE value > 90")
def _event_lookup(spark, d):
    return L.event_lookup(_panes(spark, d), events(spark, d).where("value > 90"), "event_id", ["pane_id"])


@add("detector_plugin", f"SELECT count(*) AS n, 0 AS below FROM (SELECT DISTINCT {DAY}, event_type FROM events)")
def _detector(spark, d):
    daily = Monitor("ts", tumbling("1 day"), "event_type").check(M.count(), None, "n").run(events(spark, d))
    return L.ZScoreDetector("window_end", "event_type", buffer=7).score(daily).agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0).alias("below"))


# ---- polluters ---------------------------------------------------------------------------
def HIT():
    return F.col("event_id") % 10 == 3


@add("pollute_permute", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _permute(spark, d):
    p = P.permute(["o_orderstatus", "o_orderpriority"], 3, ["o_orderkey"], F.col("o_orderkey") % 4 == 1)
    return p(orders(spark, d)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@add("pollute_concat", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN concat_ws(' ', event_type, props) ELSE event_type END AS event_type, CASE WHEN event_id % 10 = 3 THEN NULL ELSE props END AS props FROM events")
def _concat(spark, d):
    return P.concat_shift(["event_type", "props"], "event_type", HIT())(events(spark, d)).select("event_id", "event_type", "props")


@add("pollute_transform", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN upper(event_type) ELSE event_type END AS event_type FROM events")
def _transform(spark, d):
    return P.transform(["event_type"], F.upper, HIT())(events(spark, d)).select("event_id", "event_type")


@add("pollute_conditions", "SELECT event_id, CASE WHEN event_id % 10 = 3 AND value > 50 THEN NULL ELSE value END AS value FROM events")
def _conditions(spark, d):
    test = P.all_of(P.always(), HIT(), P.where(F.col("value") > 50), P.probability(1.1, 4, "event_id"))
    return P.replace(["value"], None, test)(events(spark, d)).select("event_id", "value")


@add("pollute_negative_cosine", "SELECT event_id, CASE WHEN 1 - (0.5 * cos(epoch(date_trunc('second', ts)) * (6.283185307179586 / 86400)) + 0.5) > 0.8 THEN NULL ELSE value END AS value FROM events")
def _negative(spark, d):
    return P.replace(["value"], None, P.cosine_share(F.col("ts"), 86400, negative=True) > 0.8)(events(spark, d)).select("event_id", "value")


@add("pollution_log_union", "SELECT polluter, count(*) AS n FROM (SELECT 'replace' AS polluter FROM events WHERE event_id % 10 = 3 AND event_type <> 'view' UNION ALL SELECT 'multiply' FROM events WHERE event_id % 10 = 3 AND value <> 0) GROUP BY ALL")
def _logs(spark, d):
    e = events(spark, d)
    both = L.union_logs(P.log(e, P.replace(["event_type"], "view", HIT()), "event_id"), P.log(e, P.multiply(["value"], 2, HIT()), "event_id"))
    return both.groupBy("polluter").agg(F.count("*").alias("n"))


@add("pollute_noise_bounds", "SELECT count(*) AS n, 0 AS touched_outside, true AS noise_near_zero, true AS half_empty FROM events")
def _noise(spark, d):
    e = events(spark, d)
    noisy = P.gaussian(["value"], 0, 1, 3, ["event_id"], HIT())(e).select("event_id", F.col("value").alias("v"))
    empty = P.semi_empty(["props", "event_type"], 0.5, 4, ["event_id"], HIT())(e).select("event_id", (F.col("props").isNull().cast("int") + F.col("event_type").isNull().cast("int")).alias("nulls"))
    got = e.select("event_id", "value", (F.col("props").isNull().cast("int") + F.col("event_type").isNull().cast("int")).alias("before")).join(noisy, "event_id").join(empty, "event_id")
    gone = F.when(HIT(), F.col("v") - F.col("value"))
    return got.agg(
        F.count("*").alias("n"), F.count_if(~HIT() & (~F.col("v").eqNullSafe(F.col("value")) | (F.col("nulls") != F.col("before")))).alias("touched_outside"),
        (F.abs(F.avg(gone)) < 0.5).alias("noise_near_zero"), (F.count_if(HIT() & (F.col("nulls") < 1)) == 0).alias("half_empty"),
    )


@add("inject_late_bounds", "SELECT count(*) AS n, true AS late_share, 0 AS out_of_bounds FROM events")
def _late_bounds(spark, d):
    out = P.late_arrivals("ts", 0.1, 120, 300, 5, ["event_id"])(events(spark, d))
    gap = F.unix_timestamp(F.col("ingestion_time").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return out.agg(F.count("*").alias("n"), (F.avg((gap >= 100).cast("int")).between(0.05, 0.15)).alias("late_share"), F.count_if((gap < 0) | (gap > 301)).alias("out_of_bounds"))


@add("measure_approx_bounds", "SELECT true AS near_count, true AS near_share FROM (SELECT 1)")
def _approx(spark, d):
    m = Monitor("ts", tumbling("1 day"), "event_type").check(M.distinct_count_approx("user_id"), None, "a").check(M.distinct_count("user_id"), None, "x")
    m.check(M.distinct_fraction_approx("user_id"), None, "f").check(M.distinct_fraction("user_id"), None, "y")
    got = m.run(events(spark, d))
    near = lambda a, b: F.avg((F.abs(F.col(a) - F.col(b)) <= 0.15 * F.col(b) + 1).cast("int")) >= 0.99
    return got.agg(near("a", "x").alias("near_count"), near("f", "y").alias("near_share"))


# ---- sources and helpers ----------------------------------------------------------------
@add("range_stream", "SELECT range AS value FROM range(5, 55)")
def _range(spark, d):
    return T.range_stream(spark, 50, 5)


@add("noisy_linear_bounds", "SELECT 400 AS n, 79800.0::DOUBLE AS total, true AS on_line")
def _linear(spark, d):
    return T.noisy_linear(spark, 400, 2.0, 1.0).agg(F.count("*").cast("int").alias("n"), F.sum("x").alias("total"), (F.max(F.abs(F.col("y") - 2 * F.col("x"))) < 6).alias("on_line"))


@add("assign_id", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def _ids(spark, d):
    return T.with_id(orders(spark, d)).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@add("months_concat", "SELECT month(o_orderdate) AS m, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 AND month(o_orderdate) IN (1, 2, 3) GROUP BY ALL")
def _months(spark, d):
    o = orders(spark, d).where(F.year("o_orderdate") >= 1996)
    months = [o.where(F.month("o_orderdate") == m) for m in (1, 2, 3)]
    return months[0].unionByName(months[1]).unionByName(months[2]).groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@add("capped_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _capped(spark, d):
    return orders(spark, d).orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@add("ground_truth_matches", "SELECT event_id, value > 50 AS true_label FROM events WHERE event_id % 10 = 3")
def _truth(spark, d):
    e = events(spark, d)
    truth = e.select("event_id", (F.col("value") > 50).alias("true_label"))
    return truth.join(e.where("event_id % 10 = 3").select("event_id"), "event_id", "left_semi")


@add("time_parts", "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, (epoch_ms(ts) // 900000) * 900000 + 900000 AS pane_end FROM events")
def _parts(spark, d):
    pane = SC.range_id("p", SC.floor_millis(F.col("ts"), 900), 900)
    return events(spark, d).select("event_id", F.hour("ts").cast("long").alias("h"), F.minute("ts").cast("long").alias("mi"), F.second("ts").cast("long").alias("s"), SC.id_end(pane).alias("pane_end"))


@add("feature_vectors", "SELECT event_id, coalesce(value, 0.0) AS a, cast(user_id AS DOUBLE) AS b, 0.0::DOUBLE AS c, 3 AS errors FROM events")
def _features(spark, d):
    v = SC.feature_vector("value", "user_id", "event_type")
    n = SC.violation_count(F.lit("3 errors: x"))
    return events(spark, d).select("event_id", v[0].alias("a"), v[1].alias("b"), v[2].alias("c"), n.alias("errors"))


@add("numeric_columns", "SELECT * FROM (VALUES ('event_id'), ('user_id'), ('value')) v(name)")
def _numeric(spark, d):
    return spark.createDataFrame([(c,) for c in L.numeric_columns(events(spark, d))], "name string")
