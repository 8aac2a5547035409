"""Denial-constraint queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dc
from .dc_rules import group_rules, rule

Q: dict = {}
SQL: dict[str, str] = {}


def lineitem(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


#: rows are told apart, so a pair is two rows; a row with itself is taken off
_ROWS = "SELECT (SELECT count(*) FROM {t} s JOIN {t} t ON {on}) - (SELECT count(*) FROM {t} s WHERE {own}) AS violations"


def _predicates(text, s, t):
    parts = [p.split() for p in text.split(",")]
    return " AND ".join(f"{s}.{a} {op} " + (b if b[0].isdigit() else f"{t}.{b}") for a, op, b in parts)


def _count(name, text, table="lineitem"):
    Q[name] = lambda spark, d: dc.count(spark.read.parquet(f"{d}/{table}.parquet"), rule(text))
    SQL[name] = _ROWS.format(t=table, on=_predicates(text, "s", "t"), own=_predicates(text, "s", "s"))


_count("dc_eq_only_count", "l_partkey = l_partkey, l_suppkey = l_suppkey")
_count("dc_one_ineq_count", "l_suppkey = l_suppkey, l_extendedprice > l_extendedprice")
_count("dc_one_ineq_count_loose", "l_suppkey = l_suppkey, l_quantity <= l_quantity")
_count("dc_hetero_ineq_count", "l_suppkey = l_suppkey, l_tax > l_discount")
_count("dc_two_ineq_count", "l_quantity = l_quantity, l_tax = l_tax, l_extendedprice > l_extendedprice, l_discount < l_discount")
_count("dc_two_ineq_tree", "l_suppkey = l_suppkey, l_extendedprice > l_extendedprice, l_discount < l_discount")
_count("dc_two_hetero_count", "l_suppkey = l_suppkey, l_tax > l_discount, l_discount <= l_tax")
_count("dc_multi_ineq_count", "l_partkey = l_partkey, l_extendedprice > l_extendedprice, l_discount < l_discount, l_tax >= l_tax")
_count("dc_multi_hetero_count", "l_partkey = l_partkey, l_extendedprice > l_extendedprice, l_discount < l_tax, l_tax >= l_discount")
_count("dc_cross_equality", "l_partkey = l_suppkey, l_suppkey = l_partkey")
_count("dc_unequal_count", "l_partkey = l_partkey, l_suppkey <> l_suppkey")
_count("dc_unequal_and_order", "l_suppkey = l_suppkey, l_returnflag <> l_returnflag, l_extendedprice < l_extendedprice")
_count("dc_string_order", "l_suppkey = l_suppkey, l_returnflag < l_returnflag, l_quantity >= l_quantity")
_count("dc_date_order", "l_partkey = l_partkey, l_shipdate < l_shipdate, l_extendedprice > l_extendedprice")
_count("dc_constant_predicate", "l_partkey = l_partkey, l_quantity > 40, l_discount > l_discount")
_count("dc_orders_date_price", "o_custkey = o_custkey, o_orderdate < o_orderdate, o_totalprice > o_totalprice", "orders")
_count("dc_orders_status", "o_custkey = o_custkey, o_orderstatus = o_orderstatus, o_orderpriority <> o_orderpriority", "orders")
_count("dc_customer_balance", "c_nationkey = c_nationkey, c_mktsegment = c_mktsegment, c_acctbal >= c_acctbal", "customer")
_count("dc_part_size_price", "p_brand = p_brand, p_size < p_size, p_retailprice > p_retailprice", "part")
_count("dc_supplier_balance", "s_nationkey = s_nationkey, s_acctbal < s_acctbal", "supplier")
_count("dc_events_value", "event_type = event_type, user_id = user_id, ts < ts, value > value", "events")


def _exists(name, text, sql):
    Q[name] = lambda spark, d: dc.exists(lineitem(spark, d), rule(text))
    SQL[name] = sql


_exists("dc_one_ineq_exists", "l_returnflag = l_returnflag, l_extendedprice > l_extendedprice", "SELECT bool_or(hi > lo) AS violated FROM (SELECT max(l_extendedprice) hi, min(l_extendedprice) lo FROM lineitem GROUP BY l_returnflag)")
_exists("dc_two_ineq_exists", "l_partkey = l_partkey, l_tax > l_tax, l_discount < l_discount", f"SELECT count(*) > 0 AS violated FROM lineitem s JOIN lineitem t ON {_predicates('l_partkey = l_partkey, l_tax > l_tax, l_discount < l_discount', 's', 't')}")
_exists("dc_never_exists", "l_orderkey = l_orderkey, l_quantity > 50, l_tax > l_tax", f"SELECT count(*) > 0 AS violated FROM lineitem s JOIN lineitem t ON {_predicates('l_orderkey = l_orderkey, l_quantity > 50, l_tax > l_tax', 's', 't')}")

PRICE = "o_custkey = o_custkey, o_totalprice > o_totalprice, o_orderpriority = o_orderpriority"
Q["dc_pairs"] = lambda spark, d: dc.violations(orders(spark, d), rule(PRICE), "o_orderkey")
_PAIR = "s.o_custkey = t.o_custkey AND s.o_totalprice > t.o_totalprice AND s.o_orderpriority = t.o_orderpriority AND s.o_orderkey <> t.o_orderkey"
SQL["dc_pairs"] = f"SELECT s.o_orderkey AS s_id, t.o_orderkey AS t_id FROM orders s JOIN orders t ON {_PAIR}"

RULES = [rule(PRICE, "price"), rule("o_custkey = o_custkey, o_orderpriority = o_orderpriority, o_orderdate < o_orderdate, o_totalprice > o_totalprice", "late"), rule("o_custkey = o_custkey, o_orderstatus <> o_orderstatus, o_totalprice < o_totalprice", "status")]
Q["dc_multi_rule_shared"] = lambda spark, d: dc.shared_violations(orders(spark, d), RULES, "o_orderkey").groupBy("dc_id").agg(F.count("*").alias("violations"))
Q["dc_multi_rule_counts"] = lambda spark, d: dc.counts(orders(spark, d), RULES)
SQL["dc_multi_rule_shared"] = f"""WITH p AS (SELECT s.o_orderkey a, t.o_orderkey b, {_PAIR} AS price,
    s.o_custkey = t.o_custkey AND s.o_orderpriority = t.o_orderpriority AND s.o_orderdate < t.o_orderdate AND s.o_totalprice > t.o_totalprice AS late,
    s.o_custkey = t.o_custkey AND s.o_orderstatus <> t.o_orderstatus AND s.o_totalprice < t.o_totalprice AS status
    FROM orders s JOIN orders t ON s.o_custkey = t.o_custkey AND s.o_orderkey <> t.o_orderkey)
    SELECT 'price' AS dc_id, count(*) AS violations FROM p WHERE price UNION ALL SELECT 'late', count(*) FROM p WHERE late UNION ALL SELECT 'status', count(*) FROM p WHERE status"""

SQL["dc_multi_rule_counts"] = SQL["dc_multi_rule_shared"]


def _insert(spark, d):
    o = orders(spark, d)
    return dc.insert(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 = 0"), rule(PRICE), "o_orderkey")


Q["dc_incremental_insert"] = _insert
SQL["dc_incremental_insert"] = SQL["dc_pairs"] + " WHERE s.o_orderkey % 10 = 0 OR t.o_orderkey % 10 = 0"
Q["dc_incremental_delete"] = lambda spark, d: dc.delete(dc.violations(orders(spark, d), rule(PRICE), "o_orderkey"), orders(spark, d).where("o_orderkey % 7 = 0"), "o_orderkey")
SQL["dc_incremental_delete"] = SQL["dc_pairs"] + " WHERE s.o_orderkey % 7 <> 0 AND t.o_orderkey % 7 <> 0"
Q["dc_band_join"] = lambda spark, d: dc.band_join(events(spark, d), ["event_type", "user_id"], "value", 0.5, "event_id")
SQL["dc_band_join"] = "SELECT s.event_id AS s_id, t.event_id AS t_id FROM events s JOIN events t ON s.event_type = t.event_type AND s.user_id = t.user_id AND abs(s.value - t.value) <= 0.5 AND s.event_id <> t.event_id"
WINDOWED = "user_id = user_id, event_type = event_type, value < value"
Q["dc_windowed_pairs"] = lambda spark, d: dc.windowed_pairs(events(spark, d), rule(WINDOWED), "event_id", "ts", 43200)
_WIN = "s.user_id = t.user_id AND s.event_type = t.event_type AND s.value < t.value AND s.event_id <> t.event_id AND s.ts >= t.ts AND s.ts <= t.ts + INTERVAL 12 HOUR"
SQL["dc_windowed_pairs"] = f"SELECT s.event_id AS s_id, t.event_id AS t_id FROM events s JOIN events t ON {_WIN}"
BOX = {"l_extendedprice": (1000.0, 30000.0), "l_quantity": (5.0, 20.0), "l_discount": (0.02, 0.06)}
Q["box_filter"] = lambda spark, d: lineitem(spark, d).where(dc.in_box(BOX)).select("l_orderkey", "l_linenumber")
SQL["box_filter"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 30000 AND l_quantity BETWEEN 5 AND 20 AND l_discount BETWEEN 0.02 AND 0.06"


def _boxes(spark, d):
    boxes = spark.createDataFrame([(1, 0.0, 5000.0, 1.0, 10.0), (2, 4000.0, 20000.0, 5.0, 30.0), (3, 10000.0, 90000.0, 25.0, 50.0)], "box int, p0 double, p1 double, q0 double, q1 double")
    li = lineitem(spark, d)
    # the stated rules' boxes: as many rows as there are rules
    hit = li.join(F.broadcast(boxes), li.l_extendedprice.between(boxes.p0, boxes.p1) & li.l_quantity.between(boxes.q0, boxes.q1))
    return hit.groupBy("box").agg(F.count("*").alias("n"))


Q["box_range_join"] = _boxes
SQL["box_range_join"] = "WITH b(box, p0, p1, q0, q1) AS (VALUES (1, 0, 5000, 1, 10), (2, 4000, 20000, 5, 30), (3, 10000, 90000, 25, 50)) SELECT box, count(*) AS n FROM lineitem JOIN b ON l_extendedprice BETWEEN p0 AND p1 AND l_quantity BETWEEN q0 AND q1 GROUP BY box"
Q["box_nearest"] = lambda spark, d: dc.nearest(spark.read.parquet(f"{d}/part.parquet"), [20.0, 1000.0], 15, ["p_size", "p_retailprice"], "p_partkey")
SQL["box_nearest"] = "SELECT p_partkey, round(sqrt((p_size - 20) ** 2 + (p_retailprice - 1000) ** 2), 6) AS distance FROM part ORDER BY distance, p_partkey LIMIT 15"


def _groups(spark, d):
    rows = [(i, ",".join(a for a, _ in g.signature), ",".join(r.name for r in g.rules), ",".join(g.dims)) for i, g in enumerate(group_rules(RULES))]
    return spark.createDataFrame(rows, "group_id int, keys string, rules string, dims string")


Q["rule_groups"] = _groups
