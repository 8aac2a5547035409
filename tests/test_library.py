"""Golden values and cross-checks of the library without its training-data subpackage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice import registry
from sluice.functions.assess import assess
from sluice.operators import dc, lifecycle, quality, streams
from sluice.plans.dc_rules import Predicate, group_rules, parse_text, rule
from sluice.streaming import live

SF = "/root/testdata/sf0.001"


def test_ema_and_box_golden(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 5.0)], "k string, t int, x double")
    got = streams.ema_fold(df, "k", "t", "x", 0.5, "t").first()
    assert (got["mean"], got["variance"], got["n"]) == (3.375, 6.96875, 3)
    cold = spark.createDataFrame([(0.0, 0)], "variance double, n int")
    box = streams.elastic_box(cold, 0.0, 100.0, streams.BoxConfig(delta_min=2.5)).first()
    assert (box["lo"], box["hi"]) == (-2.5, 102.5)


def test_pane_id_golden(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 10, 27, 33),)], "ts timestamp")
    row = streams.assign_panes(df, "ts", 900, 900).first()
    assert row["pane_id"] == "p_1705313700000_1705314600000"


@pytest.mark.parametrize("op, expect", [("<", {0: {2}, 1: {2}, 3: {0, 1, 2}}), ("=", {0: {1}, 1: {0}}), ("<>", {0: {2, 3}, 1: {2, 3}, 2: {0, 1, 3}})])
def test_incremental_golden(spark, op, expect):
    rows = [(0, 1, 1), (1, 1, 1), (2, 2, 2), (3, 0, 0)]
    r = rule(f"a {op} b")
    pairs, have = None, spark.createDataFrame([], "tid int, a int, b int")
    for x in rows:
        delta = spark.createDataFrame([x], have.schema)
        new = dc.insert(have, delta, r, "tid")
        pairs = new if pairs is None else pairs.union(new)
        have = have.union(delta)
    got = {}
    for s, t in pairs.collect():
        got.setdefault(s, set()).add(t)
    assert {k: v for k, v in got.items() if k in expect} == expect
    left = dc.delete(pairs, spark.createDataFrame([(0,)], "tid int"), "tid").collect()
    assert all(0 not in p for p in map(tuple, left))


def _nested_loop(rows, cols, text):
    """Ordered pairs of different rows; a null makes a predicate not hold."""
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    preds = rule(text).predicates
    at = {c: i for i, c in enumerate(cols)}

    def holds(s, t):
        for p in preds:
            a, b = s[at[p.left]], p.constant if p.constant is not None else t[at[p.right]]
            if a is None or b is None or not ops[p.op](a, b):
                return False
        return True

    return sum(i != j and holds(s, t) for i, s in enumerate(rows) for j, t in enumerate(rows))


RULES = [
    "k = k, a > a", "k = k, a <= a", "k = k, a < b", "k = k, b >= c", "k = k", "a = b, b = a", "k = k, a <> a", "k = k, a > a, b < b", "a > a, b <= c",
    "k = k, a >= a, b <= b, c > c", "k = k, s < s", "s >= s, d < d", "k = k, d <= d, a <> a, b <> b", "k = k, a > 4, b < b", "a < a",
]


@pytest.mark.parametrize("text", RULES)
def test_counts_equal_nested_loop(spark, text):
    r = random.Random(5)
    day = lambda: r.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 9))])
    cols = ["id", "k", "a", "b", "c", "s", "d"]
    rows = [(r.randint(0, 60), r.choice([None, 0, 0, 0, 1, 2]), r.choice([None, *range(9)]), r.randint(0, 9), r.randint(0, 4), r.choice([None, "", "a", "ab", "b", "é", "aaaaaaaab"]), day()) for _ in range(150)]
    rows += rows[:5]  # repeated rows, repeated ids, null keys
    df = spark.createDataFrame(rows, "id int, k int, a int, b int, c int, s string, d date")
    want = _nested_loop(rows, cols, text)
    assert dc.count(df, rule(text)).first()[0] == want
    assert dc.exists(df, rule(text)).first()[0] == (want > 0)
    assert dc.count(df.limit(0), rule(text)).first()[0] == 0 and dc.exists(df.limit(0), rule(text)).first()[0] is False


def test_groups_are_counted_in_memory_or_by_trees(spark, monkeypatch):
    r = random.Random(8)
    odd = [None, float("nan"), -0.0, 0.0, float("-inf"), 1.5, -1.5]
    cols = ["k", "f", "a", "b", "x", "y", "s"]
    rows = [(r.choice([None, 0, 0, 0, 0, 1, 2, 3]), r.choice([-0.0, 0.0, 1.0]), r.randint(0, 9), r.choice([None, *range(5)]), r.choice(odd[2:]), r.choice(odd[2:]), r.choice([None, "", "a", "é", "b"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, f double, a int, b int, x double, y double, s string").repartition(3)
    texts = ["k = k, a > a, b < b, x >= x", "k = k, a > b, b <= a, x < y", "f = f, x > x, s <= s", "k = k, f = f, a <> b, a >= a, x < x", "k = b, a > a, s < s", "k = k, a > 4, x <= y, s >= s"]
    trees = dc._total
    for chunk in (1 << 17, 40):  # all groups in memory; some in chunks and the larger by trees
        monkeypatch.setattr(dc.dominance, "CHUNK", chunk)
        # with room for a chunk no row is copied to a tree node
        monkeypatch.setattr(dc, "_total", trees if chunk < 1 << 17 else None)
        for text in texts:
            assert dc.count(df, rule(text)).first()[0] == _nested_loop(rows, cols, text), (chunk, text)
    nan = spark.createDataFrame([(1, float(x), y) for x in ("nan", "nan", 1, "-inf") for y in (1, 2)], "k int, x double, y int")
    monkeypatch.setattr(dc.dominance, "CHUNK", 1 << 17)
    assert dc.count(nan, rule("k = k, x > x, y >= y")).first()[0] == 15 and dc.count(nan, rule("k = k, x >= x, y > y")).first()[0] == 11


def test_date_orders_are_counted_in_memory(spark, monkeypatch):
    monkeypatch.setattr(dc, "_total", None)  # no row is copied to a tree node
    days = spark.createDataFrame([(1, dt.date(1969, 1, d), dt.datetime(2024, 1, d, 1), d % 2 == 0) for d in (1, 2, 3)], "k int, d date, t timestamp, b boolean")
    assert dc.count(days, rule("k = k, d < d, t < t")).first()[0] == 3 and dc.count(days, rule("k = k, d < d, b <= b")).first()[0] == 2


def test_orders_of_two_columns_are_counted_in_memory(spark, monkeypatch):
    monkeypatch.setattr(dc, "_total", None)  # no row is copied to a tree node
    r = random.Random(4)
    rows = [(r.randint(0, 3), r.randint(0, 50) / 2, r.choice([None, *range(5)]), r.randint(0, 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, p double, a int, b int")
    text = "k = k, p > p, a < b, b >= a"
    assert dc.count(df, rule(text)).first()[0] == _nested_loop(rows, df.columns, text)


@pytest.mark.parametrize("name", ["pane_states", "assign_all_windows", "assign_latest_window", "pane_window_ids", "time_parts"])
def test_times_near_a_pane_end_are_as_in_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    at = [dt.datetime(2024, 1, 15, h, 59, 59, us) for h in range(22, 24) for us in (999499, 999500, 999501, 999999)] + [dt.datetime(2024, 1, 15, 23, 59, 58, 999700), None]
    rows = [(i, t, i % 3, "view", 1.25, "{}") for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want)


def test_null_keys_are_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k int, v double")
    assert dc.exists(df, rule("k = k, v > v")).first()[0] is False
    assert dc.count(df, rule("k = k, v > v")).first()[0] == 0



def test_rules_and_assessments(spark):
    got, bad = parse_text("a = a\nnonsense\nb <= c")
    assert bad == ["nonsense"] and got.predicates[1] == Predicate("b", "<=", "c")
    assert len(rule("a <> a").decomposed()) == 2
    assert len(group_rules([rule("a = a, b > b"), rule("a = a, c < c"), rule("d = d")])) == 2
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    n = lambda t: df.where(assess(t)(F.col("x"))).count()
    assert [n(">= 2"), n("!= 2"), n("(1, 3]"), n("in [1, 3]"), n("not in [1]")] == [2, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        assess("whatever")


def test_quality_golden(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 1.0 if i > 1 else 999.0) for i in range(12)], "id int, fare double")
    checks = [quality.Check("n", "null", "fare"), quality.Check("r", "range", "fare", low=0, high=500), quality.Check("t", "type", "fare"), quality.Check("x", "regex", "id", pattern=r"\d")]
    row = quality.meta_stream(df.withColumn("g", F.lit(1)), checks, ["g"]).first()
    assert (row["total"], row["failed"], row["pass_rate"]) == (48, 2, round(46 / 48, 6))


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    x = rule("user_id = user_id, event_type = event_type, value < value")
    q = live.constraint_pairs(stream, x, "event_id", "ts", 43200, "60 days").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pairs").count() == dc.windowed_pairs(src, x, "event_id", "ts", 43200).count()


def test_registry_has_sql():
    assert len(registry.QUERIES) >= 85
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_flagship(spark):
    assert registry.QUERIES["measures_tumbling"](spark, SF).count() > 0


def test_stale_reset_and_panes(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", 1, t(0)), ("a", 2, t(400)), ("a", 3, t(500)), ("b", 4, t(0))], "k string, i int, ts timestamp")
    assert {r["i"] for r in lifecycle.fresh_only(df, "k", "ts", 300, "i").collect()} == {2, 3, 4}
    panes = spark.createDataFrame([(1000, 1), (1000, 2), (9000, 3)], "pane_end long, i int")
    got = {r["pane_end"]: r["state"] for r in lifecycle.pane_states(panes, "pane_end", 5000, 100, 2).collect()}
    assert got == {1000: "evicted", 9000: "open"}
    assert lifecycle.evict(panes, "pane_end", 5000, 100).count() == 1


def test_alert_callbacks_in_order(spark):
    w = spark.createDataFrame([(2, "b", True), (1, "a", True), (3, "c", False)], "w int, m string, alert boolean")
    seen = []
    assert lifecycle.on_alert(w, "w", "m", seen.append) == 2 and seen == ["a", "b"]
    with pytest.raises(ValueError, match="a"):
        lifecycle.on_alert(w, "w", "m")


def test_ema_and_late_batches_on_a_stream(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 5.0), ("b", 1, None)]
    spark.createDataFrame(rows, "k string, t long, x double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t long, x double").parquet(f"{tmp_path}/in")
    live.ema_stream(stream, "k", "t", "x", 0.5, "t").writeStream.format("memory").queryName("ema").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r["k"]: (r["mean"], r["variance"], r["n"]) for r in spark.table("ema").collect()}
    assert got["a"] == (3.375, 6.96875, 3) and got["b"] == (0.0, 0.0, 0)
    kept = {"late": 0, "on": 0}
    count = lambda name: lambda df, n: kept.__setitem__(name, kept[name] + df.count())
    at = stream.withColumn("ts", F.timestamp_seconds("t"))
    live.split_late_batches(at, "ts", 0, count("on"), count("late"), f"{tmp_path}/c", f"{tmp_path}/w").awaitTermination()
    assert kept == {"late": 0, "on": 4}
