"""Queries of the windowed monitor over ``events`` and friends, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.monitor import Monitor, session, sliding, tumbling

Q: dict = {}
SQL: dict[str, str] = {}

DAY = "date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end"


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def daily(name: str, checks, sql: str, post=None):
    """Register a daily check per event type: measure columns (made when run) and their SQL list."""

    def run(spark, d):
        m = Monitor("ts", tumbling("1 day"), "event_type")
        for k, v in checks().items():
            measure, must = v if isinstance(v, tuple) else (v, None)
            m.check(measure, must, k)
        out = _ntz(m.run(events(spark, d)))
        return post(out) if post else out

    Q[name] = run
    SQL[name] = f"SELECT {DAY}, event_type, {sql} FROM events GROUP BY ALL"


daily(
    "measures_tumbling",
    lambda: {"n": (M.count(), ">= 1"), "lo": M.min("value"), "hi": M.max("value"), "total": F.round(M.sum("value"), 2), "avg": (M.mean("value", 6), "[0, 1000]"), "mid": M.median("value"), "kinds": M.distinct_count("user_id"), "up": M.availability()},
    "count(*) AS n, count(*) >= 1 AS n_ok, min(value) AS lo, max(value) AS hi, round(sum(value), 2) AS total, round(avg(value), 6) AS avg, coalesce(round(avg(value), 6) BETWEEN 0 AND 1000, false) AS avg_ok, median(value) AS mid, count(DISTINCT user_id) + max(cast(user_id IS NULL AS INT)) AS kinds, count(*) > 0 AS up",
)
daily("assess_compare", lambda: {"n": (M.count(), "> 2"), "total": (F.round(M.sum("value"), 2), "< 500")}, "count(*) AS n, count(*) > 2 AS n_ok, round(sum(value), 2) AS total, coalesce(round(sum(value), 2) < 500, false) AS total_ok")
daily("assess_interval", lambda: {"avg": (M.mean("value", 6), "(5, 20]"), "n": (M.count(), "[1, 10)"), "m": (M.count_non_null("value"), "not in [1, 2]")}, "round(avg(value), 6) AS avg, coalesce(round(avg(value), 6) > 5 AND round(avg(value), 6) <= 20, false) AS avg_ok, count(*) AS n, count(*) >= 1 AND count(*) < 10 AS n_ok, count(value) AS m, count(value) NOT IN (1, 2) AS m_ok")
daily("measure_lengths", lambda: {"a": M.min_length("props"), "b": M.max_length("props"), "c": M.mean_length("props"), "d": M.median_length("props")}, "min(length(props)) AS a, max(length(props)) AS b, round(avg(length(props)), 3) AS c, median(length(props)) AS d")
_INT = "length(cast(cast(floor(abs(value)) AS BIGINT) AS VARCHAR))"
_FR = "rtrim(split_part(cast(cast(abs(value) AS DECIMAL(38,10)) AS VARCHAR), '.', 2), '0')"
_FRAC = f"length(cast(cast(CASE WHEN {_FR} = '' THEN '0' ELSE {_FR} END AS HUGEINT) AS VARCHAR))"
daily(
    "measure_digits",
    lambda: {"a": M.min_integer_part_length("value"), "b": M.max_integer_part_length("value"), "c": M.mean_integer_part_length("value"), "d": M.median_integer_part_length("value"), "e": M.min_fractional_part_length("value"), "f": M.max_fractional_part_length("value"), "g": M.mean_fractional_part_length("value"), "h": M.median_fractional_part_length("value")},
    f"min({_INT}) AS a, max({_INT}) AS b, round(avg({_INT}), 3) AS c, median({_INT}) AS d, min({_FRAC}) AS e, max({_FRAC}) AS f, round(avg({_FRAC}), 3) AS g, median({_FRAC}) AS h",
)
_MISS = "value IS NULL OR cast(value AS VARCHAR) = '' OR value IN (6.55, 12.31)"
daily("measure_missing", lambda: {"a": M.missing_count("value", [6.55, 12.31]), "b": M.missing_fraction("value", [6.55, 12.31])}, f"count_if({_MISS}) AS a, round(count_if({_MISS}) / count(*), 3) AS b")
daily("measure_conformance", lambda: {"a": M.range_conformance_count("value", 5, 20), "b": M.range_conformance_fraction("value", 5, 20, (True, False)), "c": M.set_conformance_count("user_id", [1, 2, 3]), "d": M.set_conformance_fraction("user_id", [1, 2, 3])}, "count_if(value BETWEEN 5 AND 20) AS a, round(count_if(value >= 5 AND value < 20) / count(*), 3) AS b, count_if(user_id IN (1,2,3)) AS c, round(count_if(user_id IN (1,2,3)) / count(*), 3) AS d")
daily("measure_regex", lambda: {"a": M.regex_conformance_count("props", r"\{\"k\": [1-4]"), "b": M.regex_conformance_fraction("props", r"\{\"k\": [1-4]")}, r"""count_if(regexp_matches(props, '^(?:\{"k": [1-4])')) AS a, round(count_if(regexp_matches(props, '^(?:\{"k": [1-4])')) / count(*), 3) AS b""")
daily("measure_percentiles", lambda: {"p": M.percentiles("value", precision=6)}, "round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75", lambda df: df.select("window_start", "window_end", "event_type", *(F.col("p")[float(k)].alias(f"p{k}") for k in (25, 50, 75))))
daily("measure_first_digit", lambda: {"m": M.first_digit_frequencies("value")}, ", ".join(f"cast(count_if(substr(cast(cast(abs(value) AS DECIMAL(38,10)) AS VARCHAR), 1, 1) = '{i}') AS DOUBLE) AS d{i}" for i in range(10)), lambda df: df.select("window_start", "window_end", "event_type", *(F.col("m")[i][0].alias(f"d{i}") for i in range(10))))
daily("measure_is_frozen", lambda: {"a": M.is_frozen("value"), "b": M.is_frozen("event_type")}, "min(coalesce(cast(value AS VARCHAR), 'null')) = max(coalesce(cast(value AS VARCHAR), 'null')) AS a, true AS b")
daily("measure_ordering", lambda: {"a": M.satisfies_ordering("event_id", "ts"), "b": M.satisfies_ordering("event_id", "ts", "DESC")}, "list(event_id ORDER BY ts, event_id) = list_sort(list(event_id)) AS a, list(event_id ORDER BY ts, event_id) = list_reverse_sort(list(event_id)) AS b")
daily("measure_variance", lambda: {"v": F.round(F.var_pop("value"), 2), "s": M.std_dev("value", 2), "compat": M.std_dev("value", 2, compat=True)}, "round(var_pop(value), 2) AS v, round(stddev_pop(value), 2) AS s, round(var_pop(value), 2) AS compat")
daily("measure_distinct", lambda: {"a": M.distinct_count("user_id"), "b": M.distinct_fraction("user_id"), "c": M.distinct_placeholder_count("user_id", [1, 2, 7]), "d": M.distinct_placeholder_fraction("user_id", [1, 2, 7]), "e": M.duplicate_count("user_id")}, "count(DISTINCT user_id) AS a, round(count(DISTINCT user_id) / count(*), 3) AS b, count(DISTINCT CASE WHEN user_id IN (1,2,7) THEN user_id END) AS c, round(count(DISTINCT CASE WHEN user_id IN (1,2,7) THEN user_id END) / count(*), 3) AS d, count(user_id) - count(DISTINCT user_id) AS e")
daily("measure_arithmetic", lambda: {"m": M.missing_count("value") + M.missing_count("user_id"), "gap": F.round(M.max("value") - M.min("value"), 4)}, "count_if(value IS NULL) + count_if(user_id IS NULL) AS m, round(max(value) - min(value), 4) AS gap")
daily("measure_tuples", lambda: {"a": M.tuple_sorted("user_id"), "b": M.tuple_sorted_by_time("ts", "event_id"), "w": M.window_duration()}, "list_sort(list(user_id)) AS a, list(event_id ORDER BY ts, event_id) AS b, 86400.0 AS w", lambda df: df.select("window_start", "window_end", "event_type", F.concat_ws(",", "a").alias("a"), F.concat_ws(",", "b").alias("b"), "w"))
SQL["measure_tuples"] = f"SELECT {DAY}, event_type, array_to_string(list_sort(list(user_id)), ',') AS a, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS b, cast(86400 AS DOUBLE) AS w FROM events GROUP BY ALL"
daily("measure_trend", lambda: {"t": M.trend("value", F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600, 2)}, "coalesce(round(regr_slope(value, floor(epoch(ts)) / 3600), 2), 0) AS t")
daily("measure_corr_pearson", lambda: {"r": M.correlation("value", "user_id", 2)}, "CASE WHEN stddev_pop(value) = 0 OR stddev_pop(user_id) = 0 OR count(*) < 2 THEN NULL ELSE round(corr(value, user_id), 2) + 0.0 END AS r")


def _weekly(name, measure, sql):
    def run(spark, d):
        return _ntz(Monitor("ts", tumbling("7 days", "4 days"), "event_type").check(measure, None, "r").run(events(spark, d)))

    Q[name] = run
    SQL[name] = sql


WEEK = "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS window_start, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') + INTERVAL 7 DAY AS window_end"
_weekly(
    "measure_corr_spearman", M.correlation("value", "user_id", 2, "spearman"),
    f"""WITH e AS (SELECT {WEEK}, event_type, value, user_id FROM events),
    r AS (SELECT *, rank() OVER (PARTITION BY window_start, event_type ORDER BY value) + (count(*) OVER (PARTITION BY window_start, event_type, value) - 1) / 2 AS a,
      rank() OVER (PARTITION BY window_start, event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY window_start, event_type, user_id) - 1) / 2 AS b FROM e)
    SELECT window_start, window_end, event_type, round(corr(a, b), 2) + 0.0 AS r FROM r GROUP BY ALL""",
)
_weekly("measure_corr_kendall", M.correlation("value", "user_id", 2, "kendall"), f"""WITH e AS (SELECT {WEEK}, event_type, event_id, value v, user_id u FROM events),
    p AS (SELECT a.window_start, a.window_end, a.event_type, sign(a.v - b.v) sv, sign(a.u - b.u) su FROM e a JOIN e b ON a.window_start = b.window_start AND a.event_type = b.event_type AND a.event_id < b.event_id)
    SELECT window_start, window_end, event_type, round(sum(sv * su) / sqrt(sum(abs(sv)) * sum(abs(su))), 2) + 0.0 AS r FROM p GROUP BY ALL""")
_weekly("measure_corr_cramer", M.correlation("user_bucket", "value_bucket", 2, "cramer"), "")


def _cramer(spark, d):
    e = events(spark, d).withColumns({"user_bucket": F.col("user_id") % 3, "value_bucket": F.floor("value").cast("long") % 2})
    return _ntz(Monitor("ts", tumbling("7 days", "4 days"), "event_type").check(M.correlation("user_bucket", "value_bucket", 2, "cramer"), None, "r").run(e))


Q["measure_corr_cramer"] = _cramer
SQL["measure_corr_cramer"] = f"""WITH e AS (SELECT {WEEK}, event_type, user_id % 3 a, cast(floor(value) AS BIGINT) % 2 b FROM events WHERE value IS NOT NULL),
    c AS (SELECT window_start, window_end, event_type, a, b, count(*) n FROM e GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY window_start, event_type, a) r, sum(n) OVER (PARTITION BY window_start, event_type, b) k FROM c)
    SELECT window_start, window_end, event_type, round(sqrt((sum(n * n / (r * k)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 2) AS r FROM t GROUP BY ALL"""


def _staged(spark, d):
    m = Monitor("ts", tumbling("1 day"), "event_type")
    m.check(M.unique_count("user_id"), None, "u").check(M.unique_fraction("user_id"), None, "uf").check(M.unique_over_distinct_fraction("user_id"), None, "ud").check(M.constancy("user_id"), None, "top")
    return _ntz(m.run(events(spark, d)))


Q["measure_unique"] = _staged
_FREQ = f"WITH f AS (SELECT {DAY}, event_type, user_id AS v, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY window_start, event_type) AS top FROM f)"
SQL["measure_unique"] = f"{_FREQ} SELECT window_start, window_end, event_type, count_if(n = 1) AS u, round(count_if(n = 1) / sum(n), 3) AS uf, round(count_if(n = 1) / count(*), 3) AS ud, max(n) AS top FROM t GROUP BY ALL"


def _frequent(spark, d):
    m = Monitor("ts", tumbling("1 day"), "event_type")
    m.check(M.most_frequent("user_id"), None, "v").check(M.range_conformance_count_only_most_frequent("user_id", 1, 50), None, "rc").check(M.range_conformance_fraction_only_most_frequent("user_id", 1, 50), None, "rf")
    m.check(M.set_conformance_count_only_most_frequent("user_id", [1, 2, 3]), None, "sc").check(M.set_conformance_fraction_only_most_frequent("user_id", [1, 2, 3]), None, "sf")
    return _ntz(m.run(events(spark, d))).withColumn("v", F.concat_ws(",", "v"))


Q["measure_most_frequent"] = _frequent
SQL["measure_most_frequent"] = f"{_FREQ} SELECT window_start, window_end, event_type, array_to_string(list_sort(list(v) FILTER (n = top)), ',') AS v, count_if(n = top AND v BETWEEN 1 AND 50) AS rc, round(count_if(n = top AND v BETWEEN 1 AND 50) / count_if(n = top), 3) AS rf, count_if(n = top AND v IN (1,2,3)) AS sc, round(count_if(n = top AND v IN (1,2,3)) / count_if(n = top), 3) AS sf FROM t GROUP BY ALL"


def _above(spark, d):
    m = Monitor("ts", tumbling("1 day"), "event_type").check(M.above_mean_count("value"), None, "a").check(M.above_mean_fraction("value"), None, "f")
    return _ntz(m.run(events(spark, d)))


Q["measure_above_mean"] = _above
SQL["measure_above_mean"] = f"WITH e AS (SELECT {DAY}, event_type, value FROM events), m AS (SELECT *, avg(value) OVER (PARTITION BY window_start, event_type) AS mean FROM e) SELECT window_start, window_end, event_type, count_if(value > mean) AS a, round(count_if(value > mean) / count(*), 3) AS f FROM m GROUP BY ALL"
Q["measure_approx"] = lambda spark, d: _ntz(Monitor("ts", tumbling("1 day"), "event_type").check(M.distinct_count_approx("user_id"), None, "a").check(M.distinct_fraction_approx("user_id"), None, "f").check(M.most_frequent_approx("user_id"), None, "k").run(events(spark, d)))

_BASIC = lambda: {"n": M.count(), "lo": M.min("value"), "hi": M.max("value"), "mid": M.median("value")}


def _kind(window, instance):
    def run(spark, d):
        m = Monitor("ts", window, instance)
        for k, v in _BASIC().items():
            m.check(v, None, k)
        return _ntz(m.run(events(spark, d)))

    return run


_B = "count(*) AS n, min(value) AS lo, max(value) AS hi, median(value) AS mid"
Q["measures_sliding"] = _kind(sliding("2 days", "1 day"), "event_type")
SQL["measures_sliding"] = f"SELECT date_trunc('day', ts) - o * INTERVAL 1 DAY AS window_start, date_trunc('day', ts) - o * INTERVAL 1 DAY + INTERVAL 2 DAY AS window_end, event_type, {_B} FROM events, (VALUES (0), (1)) t(o) GROUP BY ALL"
Q["measures_session"] = _kind(session("6 hours"), "user_id")
SQL["measures_session"] = f"WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, {_B} FROM s GROUP BY user_id, g"
