"""Queries of quality rules, panes, boxes, anomalies, alerts and pollution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dc, pollute as P, quality as QL, streams as S
from ..operators.monitor import Monitor, tumbling
from ..functions import measures as M
from ..sources import tables as T
from .dc_queries import WINDOWED
from .dc_rules import rule
from .monitor_queries import _ntz

Q: dict = {}
SQL: dict[str, str] = {}


def add(name, sql):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


CHECKS = [QL.Check("c_null", "null", "user_id"), QL.Check("c_type", "type", "value", type="bigint"), QL.Check("c_range", "range", "value", low=1, high=100), QL.Check("c_regex", "regex", "event_type", pattern="c|v"), QL.Check("c_other", "unknown", "value")]
_NOTINT = "value IS NOT NULL AND value <> trunc(value)"
_FAIL = {"c_null": "user_id IS NULL", "c_range": "value < 1 OR value > 100", "c_regex": "NOT regexp_matches(event_type, '^(?:c|v)')"}


@add("dq_rules_per_record", "SELECT event_id, " + ", ".join(f"CASE WHEN {f} THEN 'fail' ELSE 'pass' END AS {n}" for n, f in _FAIL.items()) + ", 'skip' AS c_other FROM events")
def _rules(spark, d):
    return QL.check_records(events(spark, d), [c for c in CHECKS if c.name != "c_type"]).select("event_id", *_FAIL, "c_other")


@add("dq_meta_stream", f"WITH g AS (SELECT date_trunc('day', ts) AS day, count(*) AS events, {', '.join(f'count_if({f}) AS fail_{n}' for n, f in _FAIL.items())} FROM events GROUP BY ALL) SELECT *, events * 4 AS total, fail_c_null + fail_c_range + fail_c_regex AS failed, events * 4 - (fail_c_null + fail_c_range + fail_c_regex) AS passed, round(1 - (fail_c_null + fail_c_range + fail_c_regex) / (events * 4), 6) AS pass_rate FROM g")
def _meta(spark, d):
    e = events(spark, d).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return QL.meta_stream(e, [c for c in CHECKS if c.name not in ("c_type",)], ["day"])


FIELDS = [QL.Field("value", "double", ge=1, lt=100), QL.Field("event_type", "string", max_length=6, pattern="^[a-z]+$"), QL.Field("user_id", "bigint", gt=3)]
_ERR = "[CASE WHEN value < 1 THEN 'value -> violates ge 1' END, CASE WHEN value >= 100 THEN 'value -> violates lt 100' END, CASE WHEN length(event_type) > 6 THEN 'event_type -> is longer than 6' END, CASE WHEN user_id <= 3 THEN 'user_id -> violates gt 3' END]"
_VAL = f"(SELECT *, len(list_filter({_ERR}, lambda x: x IS NOT NULL)) AS n, array_to_string(list_filter({_ERR}, lambda x: x IS NOT NULL), '; ') AS m FROM events)"


@add("schema_validate", f"SELECT event_id, n = 0 AS _ok, CASE WHEN n > 0 THEN n || ' errors: ' || m ELSE '' END AS _message FROM {_VAL}")
def _validate(spark, d):
    return QL.validate(events(spark, d), FIELDS).select("event_id", "_ok", "_message")


@add("schema_deflect", f"SELECT event_id, n || ' errors: ' || m AS _message FROM {_VAL} WHERE n > 0")
def _deflect(spark, d):
    return QL.deflect(QL.validate(events(spark, d), FIELDS)).select("event_id", "_message")


@add("schema_keep", f"SELECT event_id, value FROM {_VAL} WHERE n = 0")
def _keep(spark, d):
    return QL.keep_compliant(QL.validate(events(spark, d), FIELDS)).select("event_id", "value")


def _errors_by_hour(spark, d):
    v = QL.validate(events(spark, d), FIELDS)
    from ..functions.scalars import violation_count

    return v.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum(violation_count(F.col("_message"))).alias("errors"), F.count("*").alias("n"))


_HOURLY = f"SELECT date_trunc('hour', ts) AS hour, sum(n) AS errors, count(*) AS n FROM {_VAL} GROUP BY ALL"


@add("schema_error_counts", _HOURLY)
def _counts(spark, d):
    return _errors_by_hour(spark, d)


@add("schema_alert_first_k", f"WITH w AS ({_HOURLY}), r AS (SELECT *, sum(CASE WHEN errors = 0 THEN 1 ELSE 0 END) OVER (ORDER BY hour) AS run FROM w) SELECT hour, errors, n, errors > 0 AND sum(CASE WHEN errors > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY hour) <= 2 AS alert FROM r")
def _first_k(spark, d):
    return QL.alert_mode(_errors_by_hour(spark, d), "hour", "errors", "only_on_first_k", 2)


@add("compact_to_native", "SELECT l_orderkey, l_linenumber, l_quantity AS qty, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS tax FROM lineitem")
def _compact(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    names = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("qty"), F.lit("tax"))).otherwise(F.array(F.lit("qty")))
    vals = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_quantity", "l_tax")).otherwise(F.array("l_quantity"))
    return T.compact_to_native(li.withColumns({"fields": names, "values": vals}), {"qty": "double", "tax": "double"}, keep=("l_orderkey", "l_linenumber"))


@add("ingest_normalize", "SELECT cast(event_id AS VARCHAR) AS event_id, date_trunc('second', ts) AS event_time, cast(user_id AS VARCHAR) AS partition_key, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN 'value is required' END AS reject FROM events")
def _ingest(spark, d):
    e = events(spark, d)
    raw = e.select(F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("value").cast("string")).alias("value"))
    out = T.normalise(raw, T.EventSchema("t", "%Y-%m-%d %H:%M:%S", None, "user_id", {"user_id": "int", "value": "float"}, ("value",)), "event_id")
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "partition_key", "user_id", "value", "reject")


@add("resample_join", "WITH m AS (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS c, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, round(v, 6) AS mean_value FROM events e LEFT JOIN m ON e.user_id = m.user_id AND time_bucket(INTERVAL 15 MINUTE, e.ts) = m.c WHERE event_type = 'view'")
def _resample(spark, d):
    e = events(spark, d)
    return T.resample_join(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "ts", "value", ["user_id"], "15 minutes").select("event_id", F.round("mean_value", 6).alias("mean_value"))


@add("clean_prepare", "WITH x AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, cast(floor(epoch(nxt)) AS BIGINT) - cast(floor(epoch(ts)) AS BIGINT) AS duration FROM x WHERE nxt IS NOT NULL AND value > 0 AND cast(floor(epoch(nxt)) AS BIGINT) - cast(floor(epoch(ts)) AS BIGINT) BETWEEN 60 AND 10800")
def _clean(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("nxt", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("nxt is not null")
    return T.clean(e, ["value"], "ts", "nxt", 60, 10800).select("event_id", "duration")


# ---- panes ------------------------------------------------------------------
_MS = "epoch_ms(ts)"
_PANE = f"({_MS} // 120000) * 120000 AS window_start_ms, ({_MS} // 60000) * 60000 AS pane_start_ms"


@add("pane_window_ids", f"SELECT event_id, {_PANE}, 'w_' || ({_MS} // 120000) * 120000 || '_' || (({_MS} // 120000) * 120000 + 600000) AS window_id, 'p_' || ({_MS} // 60000) * 60000 || '_' || (({_MS} // 60000) * 60000 + 60000) AS pane_id FROM events")
def _panes(spark, d):
    return S.assign_panes(events(spark, d), "ts", 600, 120, 60).select("event_id", "window_start_ms", "pane_start_ms", "window_id", "pane_id")


@add("assign_latest_window", f"SELECT ({_MS} // 3600000) * 3600000 AS window_start_ms, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _latest(spark, d):
    return S.assign_panes(events(spark, d), "ts", 7200, 3600).groupBy("window_start_ms").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@add("assign_all_windows", f"SELECT ({_MS} // 3600000) * 3600000 - o * 3600000 AS window_start_ms, count(*) AS n FROM events, (VALUES (0), (1), (2)) t(o) GROUP BY ALL")
def _all(spark, d):
    return S.assign_all_windows(events(spark, d), "ts", 10800, 3600).groupBy("window_start_ms").agg(F.count("*").alias("n"))


WM = 1705276800000  # 2024-01-15


@add("window_slide_delta", f"SELECT event_id, CASE WHEN ({_MS} // 3600000) * 3600000 + 7200000 <= {WM} THEN 'delete' WHEN {_MS} >= {WM} - 3600000 AND {_MS} < {WM} THEN 'insert' WHEN {_MS} >= {WM} AND {_MS} < {WM} + 3600000 THEN 'delete' END AS change FROM events WHERE {_MS} < {WM} + 3600000 AND (({_MS} // 3600000) * 3600000 + 7200000 <= {WM} OR {_MS} >= {WM} - 3600000)")
def _delta(spark, d):
    return S.slide_delta(events(spark, d), "ts", WM, 7200, 3600).select("event_id", "change")


_ARR = "(SELECT *, ts + CASE WHEN event_id % 10 = 3 THEN INTERVAL 40 MINUTE ELSE INTERVAL 0 MINUTE END AS arrival FROM events)"


def _arrivals(spark, d):
    return P.delay("ts", 2400, F.col("event_id") % 10 == 3)(events(spark, d))


@add("late_split", f"WITH a AS {_ARR}, m AS (SELECT event_id, {_MS} AS t, max({_MS}) OVER (PARTITION BY user_id ORDER BY arrival, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) SELECT event_id, coalesce(t < seen - 60000, false) AS late FROM m")
def _late(spark, d):
    return S.split_late(_arrivals(spark, d), "arrival", "ts", 60, ["user_id"]).select("event_id", "late")


@add("sort_drop_late", f"WITH a AS {_ARR}, m AS (SELECT event_id, {_MS} AS t, max({_MS}) OVER (PARTITION BY user_id ORDER BY arrival, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) SELECT event_id FROM m WHERE NOT coalesce(t < seen, false)")
def _drop(spark, d):
    return S.sort_drop_late(_arrivals(spark, d), "arrival", "ts", ["user_id"]).select("event_id")


@add("recent_panes", f"WITH p AS (SELECT event_id, ({_MS} // 3600000) * 3600000 + 3600000 AS pane_end FROM events) SELECT event_id, pane_end FROM p WHERE pane_end IN (SELECT DISTINCT pane_end FROM p ORDER BY pane_end DESC LIMIT 5)")
def _recent(spark, d):
    p = S.assign_panes(events(spark, d), "ts", 3600, 3600).withColumn("pane_end", F.col("pane_start_ms") + 3600000)
    return S.recent_panes(p, "pane_end", 5).select("event_id", "pane_end")


@add("session_predicate", "WITH l AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN pt IS NULL OR value - pv > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM l) SELECT user_id, session_no, count(*) AS n FROM s GROUP BY ALL")
def _session(spark, d):
    out = S.session_by_predicate(events(spark, d).select("event_id", "user_id", "ts", "value"), "user_id", "ts", F.col("value") - F.col("prev.value") > 20)
    return out.groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


_EMA = "list_reduce(list_prepend({'m': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'x': 0.0::DOUBLE}, list({'m': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'x': value} ORDER BY ts, event_id)), lambda a, b: {'m': 0.1 * b.x + 0.9 * a.m, 'v': 0.9 * a.v + 0.1 * (b.x - a.m) * (b.x - a.m), 'x': b.x})"


@add("ema_state", f"SELECT event_type, round(s.m, 6) AS mean, round(s.v, 6) AS variance, n FROM (SELECT event_type, {_EMA} AS s, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def _ema(spark, d):
    return S.ema_fold(events(spark, d), "event_type", "ts", "value", 0.1, "event_id").select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.col("n").cast("long").alias("n"))


@add("elastic_box", f"SELECT event_type, round(0 - least(greatest(3 * sqrt(s.v), 2.5), 50), 6) AS lo, round(100 + least(greatest(3 * sqrt(s.v), 2.5), 50), 6) AS hi FROM (SELECT event_type, {_EMA} AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def _box(spark, d):
    out = S.elastic_box(S.ema_fold(events(spark, d), "event_type", "ts", "value", 0.1, "event_id"), 0.0, 100.0, S.BoxConfig())
    return out.select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


# ---- anomalies -----------------------------------------------------------------
def _scored(spark, d):
    daily = Monitor("ts", tumbling("1 day"), "event_type").check(M.count(), None, "n").check(M.mean("value", 6), None, "avg").run(events(spark, d))
    return _ntz(S.rolling_scores(daily, "window_end", ["n", "avg"], 7, 3, 1.2, "event_type", 1))


_ROLL = """WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg FROM events GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start) AS i,
  avg(n) OVER r AS mn, coalesce(var_samp(n) OVER r, 0) AS vn, avg(avg) OVER r AS ma, coalesce(var_samp(avg) OVER r, 0) AS va, count(*) OVER r AS c FROM w
  WINDOW r AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
 z AS (SELECT *, CASE WHEN vn > 0 THEN abs(n - mn) / sqrt(vn) WHEN c > 1 THEN abs(n - mn) ELSE 0 END AS zn, CASE WHEN va > 0 THEN abs(avg - ma) / sqrt(va) WHEN c > 1 THEN abs(avg - ma) ELSE 0 END AS za FROM f),
 s AS (SELECT *, CASE WHEN i <= 3 THEN 0 ELSE greatest(zn, za) END AS score FROM z)"""


@add("rolling_zscore", _ROLL + " SELECT event_type, window_start, round(zn, 4) AS z_n, round(za, 4) AS z_avg, round(score, 4) AS score FROM s")
def _zscore(spark, d):
    return _scored(spark, d).select("event_type", "window_start", *(F.round(c, 4).alias(c) for c in ("z_n", "z_avg", "score")))


@add("anomaly_severity", _ROLL + " SELECT event_type, CASE WHEN i <= 3 THEN 'warmup' WHEN score <= 1.2 THEN 'normal' WHEN score <= 2.4 THEN 'moderate' WHEN score <= 3.6 THEN 'high' ELSE 'critical' END AS severity, count(*) AS n FROM s GROUP BY ALL")
def _severity(spark, d):
    return _scored(spark, d).groupBy("event_type", "severity").agg(F.count("*").alias("n"))


@add("monitor_with_anomaly", _ROLL + " SELECT event_type, window_start, n, avg, i > 3 AND score > 1.2 AS odd, CASE WHEN i > 3 AND score > 1.2 THEN CASE WHEN za >= zn THEN 'avg' ELSE 'n' END ELSE '' END AS causes FROM s")
def _joined(spark, d):
    return _scored(spark, d).select("event_type", "window_start", "n", "avg", (~F.col("severity").isin("normal", "warmup")).alias("odd"), "causes")


# ---- alerts --------------------------------------------------------------------
def _alerts(spark, d):
    e = events(spark, d)
    pairs = dc.windowed_pairs(e, rule(WINDOWED), "event_id", "ts", 43200)
    w = S.assign_panes(e, "ts", 3600, 3600).select(F.col("event_id").alias("s_id"), "window_id", "window_start_ms")
    return S.provisional_alerts(pairs.join(w, "s_id"), "dc1", "window_id")


_AL = """WITH p AS (SELECT s.event_id AS s_id, t.event_id AS t_id, (epoch_ms(s.ts) // 3600000) * 3600000 AS w FROM events s JOIN events t ON s.user_id = t.user_id AND s.event_type = t.event_type AND s.value < t.value AND s.event_id <> t.event_id AND s.ts >= t.ts AND s.ts <= t.ts + INTERVAL 12 HOUR),
 a AS (SELECT s_id, w, 'w_' || w || '_' || (w + 3600000) AS window_id, 'alert_dc1_w_' || w || '_' || (w + 3600000) || '_' || s_id AS alert_id, count(DISTINCT t_id) AS n, list_append(list(DISTINCT t_id), s_id) AS ids FROM p GROUP BY s_id, w)"""


@add("alerts_provisional", _AL + " SELECT alert_id, window_id, s_id, n + 1 AS n_events FROM a")
def _provisional(spark, d):
    return _alerts(spark, d).select("alert_id", "window_id", "s_id", F.size("event_ids").cast("long").alias("n_events"))


def _final(spark, d):
    from ..functions.scalars import id_end

    return S.finalize(_alerts(spark, d), id_end(F.col("window_id")), WM)


@add("alerts_finalize", _AL + f" SELECT CASE WHEN w + 3600000 <= {WM} THEN 'final' ELSE 'provisional' END AS status, count(*) AS n FROM a GROUP BY ALL")
def _finalize(spark, d):
    return _final(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@add("alerts_retract", _AL + f" SELECT alert_id, CASE WHEN w + 3600000 <= {WM} THEN 'final' WHEN len(list_filter(ids, lambda x: x % 10 = 3)) > 0 THEN 'retracted' ELSE 'provisional' END AS status FROM a")
def _retract(spark, d):
    return S.retract(_final(spark, d), events(spark, d).where("event_id % 10 = 3"), "event_id").select("alert_id", "status")


@add("alert_lookup", _AL + " SELECT event_id, count(*) AS n FROM (SELECT unnest(ids) AS event_id FROM a) GROUP BY ALL")
def _lookup(spark, d):
    return S.alerts_of_event(_alerts(spark, d)).groupBy("event_id").agg(F.count("*").alias("n"))


@add("alerts_expire", _AL + f" SELECT alert_id FROM a WHERE NOT (w + 3600000 <= {WM} - 86400000)")
def _expire(spark, d):
    from ..functions.scalars import id_end

    return S.expire(_final(spark, d), id_end(F.col("window_id")), WM, 86400000).select("alert_id")


@add("tombstone_filter", "SELECT event_id FROM events WHERE NOT (event_id % 10 = 3 AND hour(ts) < 12)")
def _tomb(spark, d):
    e = S.assign_panes(events(spark, d), "ts", 3600, 3600)
    return S.tombstone(e, e.where((F.col("event_id") % 10 == 3) & (F.hour("ts") < 12)), ["event_id", "pane_id"]).select("event_id")


@add("late_invalidate", "SELECT s.event_id AS s_id, t.event_id AS t_id FROM events s JOIN events t ON s.user_id = t.user_id AND s.event_type = t.event_type AND s.value < t.value AND s.event_id <> t.event_id WHERE t.event_id % 10 = 3")
def _invalidate(spark, d):
    e = events(spark, d)
    return dc._pairs(e, e.where("event_id % 10 = 3"), rule(WINDOWED), "event_id")


@add("accuracy_metrics", _AL + ", t AS (SELECT event_id FROM events WHERE value < 5), f AS (SELECT DISTINCT s_id AS event_id FROM a), c AS (SELECT (SELECT count(*) FROM t SEMI JOIN f USING (event_id)) AS tp, (SELECT count(*) FROM f ANTI JOIN t USING (event_id)) AS fp, (SELECT count(*) FROM t ANTI JOIN f USING (event_id)) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def _accuracy(spark, d):
    return QL.accuracy(events(spark, d).where("value < 5").select("event_id"), _alerts(spark, d).select(F.col("s_id").alias("event_id")), "event_id")


@add("set_ops_ids", "(SELECT event_id, 'both' AS kind FROM events WHERE event_id % 6 = 0) UNION ALL (SELECT event_id, 'left' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0)")
def _sets(spark, d):
    e = events(spark, d).select("event_id")
    a, b = e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("left")))


@add("latency_percentiles", "WITH o AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT event_type, v[1 + least(cast(floor(len(v) * 0.5) AS INT), len(v) - 1)] AS p50, v[1 + least(cast(floor(len(v) * 0.95) AS INT), len(v) - 1)] AS p95, v[1 + least(cast(floor(len(v) * 0.99) AS INT), len(v) - 1)] AS p99 FROM o")
def _latency(spark, d):
    return QL.nearest_rank(events(spark, d), "value", [0.5, 0.95, 0.99], ["event_type"])


@add("run_summary", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def _summary(spark, d):
    return QL.run_summary(events(spark, d), "value", ["event_type"])


# ---- pollution -------------------------------------------------------------------
def HIT():
    return F.col("event_id") % 10 == 3


@add("pollute_replace", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN -1.0 ELSE value END AS value FROM events")
def _p1(spark, d):
    return P.replace(["value"], -1.0, HIT())(events(spark, d)).select("event_id", "value")


@add("pollute_multiply", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN value * 100 ELSE value END AS value FROM events")
def _p2(spark, d):
    return P.multiply(["value"], 100, HIT())(events(spark, d)).select("event_id", "value")


@add("pollute_remove", "SELECT event_id FROM events WHERE event_id % 10 <> 3")
def _p3(spark, d):
    return P.remove(HIT())(events(spark, d)).select("event_id")


@add("pollute_duplicate", "SELECT cast(event_id AS VARCHAR) AS event_id, value FROM events UNION ALL SELECT event_id || '_D', value FROM events WHERE event_id % 10 = 3")
def _p4(spark, d):
    return P.duplicate("event_id", HIT())(events(spark, d)).select("event_id", "value")


@add("pollute_delay", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN ts + INTERVAL 1 HOUR ELSE ts END AS arrival FROM events")
def _p5(spark, d):
    return P.delay("ts", 3600, HIT())(events(spark, d)).select("event_id", "arrival")


_DUR = "list_reduce(list_prepend([]::BIGINT[], list_transform(list_sort(list(epoch_us(ts)) FILTER (event_id % 50 = 3)), lambda x: [x])), lambda a, b: CASE WHEN len(a) = 0 OR b[1] >= a[-1] + 86400000000 THEN list_concat(a, b) ELSE a END)"


@add("pollute_duration", f"WITH s AS (SELECT user_id, {_DUR} AS starts FROM events GROUP BY user_id) SELECT event_id, CASE WHEN len(list_filter(starts, lambda s: epoch_us(ts) >= s AND epoch_us(ts) < s + 86400000000)) > 0 THEN 0 ELSE value END AS value FROM events JOIN s USING (user_id)")
def _p6(spark, d):
    run = P.for_duration("user_id", "ts", 86400, F.col("event_id") % 50 == 3, lambda on: P.replace(["value"], 0.0, on), "event_id")
    return run(events(spark, d)).select("event_id", "value")


@add("pollute_temporal", "SELECT event_id, CASE WHEN 0.5 * cos((epoch(date_trunc('second', ts)) + 0) * (6.283185307179586 / 86400)) + 0.5 > 0.8 THEN NULL ELSE value END AS value FROM events")
def _p7(spark, d):
    return P.replace(["value"], None, P.cosine_share(F.col("ts"), 86400) > 0.8)(events(spark, d)).select("event_id", "value")


@add("pollute_composite", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN round_even(CASE WHEN event_id % 10 = 3 THEN value * 3 ELSE value END, 0) WHEN event_id % 10 = 3 THEN value * 3 ELSE value END AS value, CASE WHEN event_id % 10 = 3 THEN 'x' ELSE event_type END AS event_type FROM events")
def _p8(spark, d):
    p = P.composite(P.multiply(["value"], 3, HIT()), P.reduce_precision(["value"], 0, F.col("event_id") % 4 == 1), P.replace(["event_type"], "x", HIT()))
    return p(events(spark, d)).select("event_id", "value", "event_type")


@add("pollution_log", "SELECT cast(event_id AS VARCHAR) AS id, 'replace' AS polluter, 'event_type' AS attribute, event_type AS old_value, 'view' AS new_value FROM events WHERE event_id % 10 = 3 AND event_type <> 'view'")
def _p9(spark, d):
    return P.log(events(spark, d), P.replace(["event_type"], "view", HIT()), "event_id")


@add("inject_drift", "SELECT event_id, round(CASE WHEN hour(ts) = 18 THEN value * 2 ELSE value END * CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 + (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-20')) / 60 * 0.001 ELSE 1 END, 6) AS value FROM events")
def _p10(spark, d):
    p = P.composite(P.sudden_drift("value", "ts", 18, 2.0), P.incremental_drift("value", "ts", "2024-01-20", 0.001))
    return p(events(spark, d)).select("event_id", F.round("value", 6).alias("value"))


@add("inject_fraud", "WITH m AS (SELECT user_id, median(value) AS mid FROM events GROUP BY ALL) SELECT event_id, CASE WHEN event_id % 10 = 3 THEN mid * 2.5 + 7 ELSE value END AS value, CASE WHEN event_id % 10 = 3 THEN 'dc2' END AS noise_type FROM events JOIN m USING (user_id)")
def _p11(spark, d):
    return P.inject_pair_violations(events(spark, d), ["user_id"], "value", "event_id", 2.5, 7.0, HIT()).select("event_id", "value", "noise_type")


Q["inject_late"] = lambda spark, d: P.late_arrivals("ts", 0.1, 120, 300, 5, ["event_id"])(events(spark, d)).select("event_id", "ts", "ingestion_time")
Q["pollute_noise"] = lambda spark, d: P.composite(P.gaussian(["value"], 0, 1, 3, ["event_id"], HIT()), P.semi_empty(["props", "event_type"], 0.5, 4, ["event_id"], P.probability(0.2, 9, "event_id")))(events(spark, d))
