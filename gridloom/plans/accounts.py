"""Users, recipes, messages and spending. Customers are users, orders are their tasks, events are log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..registry import query, table


def users(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_acctbal") < 0, "PENDING").when(F.col("c_acctbal") > 9000, "LOCKED").otherwise("ACTIVE").alias("status"), (F.col("c_nationkey") * 1000).alias("uid"), "c_mktsegment", "c_acctbal")


_USERS = "u AS (SELECT c_custkey AS id, c_name AS username, CASE WHEN c_acctbal < 0 THEN 'PENDING' WHEN c_acctbal > 9000 THEN 'LOCKED' ELSE 'ACTIVE' END AS status, c_nationkey * 1000 AS uid, c_mktsegment, c_acctbal FROM customer)"


@query(f"WITH {_USERS} SELECT id, username, uid, row_number() OVER (ORDER BY uid, id) AS place FROM u WHERE status <> 'PENDING' AND uid >= 10000")
def identity_users(spark, d):
    return A.placed(users(spark, d).where("status <> 'PENDING' and uid >= 10000").select("id", "username", "uid"), ["uid", "id"])


@query(f"WITH {_USERS} SELECT id, username FROM u WHERE lower(username) IN ('customer#000000007', 'customer#000000011')")
def identity_lookup(spark, d):
    return A.by_name(users(spark, d), "username", ["CUSTOMER#000000007", "customer#000000011"]).select("id", "username")


@query("SELECT lower(c_name) AS username, max(o_orderdate) AS last_login FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL GROUP BY 1")
def last_login(spark, d):
    logins = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return A.last_login(logins.withColumn("failed", F.col("o_orderstatus") != "F"), "c_name", "o_orderdate", "failed")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderkey % 5 = 0) AND o_orderstatus NOT IN ('F')")
def not_removed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 5 == 0).alias("removed"))
    return A.present(o, "removed", "o_orderstatus", ["F"]).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part WHERE p_size < 20")
def recipes_below_version(spark, d):
    return A.placed(table(spark, d, "part").where("p_size < 20").select("p_partkey", "p_name", "p_size"), ["p_size", "p_partkey"])


@query("SELECT p_partkey, p_name, p_size > 40 AS deprecated, row_number() OVER (ORDER BY p_size > 40, p_name, p_partkey) AS place FROM part")
def dataset_list(spark, d):
    return A.placed(table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") > 40).alias("deprecated")), ["deprecated", "p_name", "p_partkey"])


@query(
    f"""WITH {_USERS} SELECT id, username, row_number() OVER (ORDER BY upper(username) DESC, id) AS place FROM u
    WHERE (lower(username) LIKE '%customer%' OR lower(c_mktsegment) LIKE '%customer%') AND (lower(username) LIKE '%mach%' OR lower(c_mktsegment) LIKE '%mach%') AND status IN ('ACTIVE', 'LOCKED')"""
)
def user_list(spark, d):
    found = A.search(users(spark, d), ["username", "c_mktsegment"], "Customer  mach").where(F.col("status").isin("ACTIVE", "LOCKED"))
    return A.placed(found.withColumn("_name", F.upper("username")).select("id", "username", "_name"), [F.desc("_name"), "id"]).drop("_name")


_SPEND = "i AS (SELECT o_custkey AS username, sum(o_totalprice) / 1000 AS instance FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), g AS (SELECT o_custkey AS username, sum(o_totalprice) / 2000 AS storage FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1), b AS (SELECT c_custkey AS username, abs(c_acctbal) / 20 AS instance_budget, abs(c_acctbal) / 40 AS storage_budget, c_nationkey * 10.0 AS quota FROM customer)"


def _spending(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    year = lambda y, by, name: o.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("username")).agg((F.sum("o_totalprice") / by).alias(name))
    budgets = c.select(F.col("c_custkey").alias("username"), (F.abs("c_acctbal") / 20).alias("instance_budget"), (F.abs("c_acctbal") / 40).alias("storage_budget"), (F.col("c_nationkey") * 10.0).alias("quota"))
    return A.spending_report(budgets, year(1997, 1000, "instance"), year(1998, 2000, "storage"), "username")


@query(f"WITH {_SPEND} SELECT username, round(coalesce(instance, 0), 6) AS instance, round(coalesce(storage, 0), 6) AS storage, round(instance_budget, 6) AS instance_budget, round(storage_budget, 6) AS storage_budget, quota::DOUBLE AS quota FROM b LEFT JOIN i USING (username) LEFT JOIN g USING (username)")
def spending_report(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _spending(spark, d).select("username", r("instance"), r("storage"), r("instance_budget"), r("storage_budget"), "quota")


@query(f"WITH {_SPEND} SELECT username, coalesce(instance, 0) >= instance_budget AS over_instance, coalesce(storage, 0) >= storage_budget AS over_storage, coalesce(storage, 0) >= quota AS over_quota FROM b LEFT JOIN i USING (username) LEFT JOIN g USING (username) WHERE coalesce(instance, 0) >= instance_budget OR coalesce(storage, 0) >= storage_budget OR coalesce(storage, 0) >= quota")
def users_over_any_budget(spark, d):
    return A.over_budget(_spending(spark, d), "username")


@query("SELECT o_custkey AS username, arg_max(o_totalprice, (year(o_orderdate), month(o_orderdate), o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_storage(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("username")).agg(F.max_by("o_totalprice", F.struct(F.year("o_orderdate"), F.month("o_orderdate"), "o_orderkey")).alias("latest"))


@query("SELECT round(sum(o_totalprice / 1000), 2) AS hourly FROM orders WHERE o_orderstatus = 'O'")
def hourly_spending(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.round(F.sum(F.col("o_totalprice") / 1000), 2).alias("hourly"))


@query(
    """WITH g AS (SELECT event_type AS tag, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events WHERE value > 100)
    SELECT tag, ts + INTERVAL 14400 SECOND AS fires_at FROM g WHERE nxt IS NULL OR nxt - ts > INTERVAL 14400 SECOND"""
)
def dead_man_rule(spark, d):
    e = table(spark, d, "events").where("value > 100").select(F.col("event_type").alias("tag"), "ts", "event_id")
    return A.silent(e, "tag", "ts", ["event_id"], 4 * 3600)


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, floor(value / 50) AS size, event_type = 'purchase' AS active, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, event_id, i, size, 600.0::DOUBLE AS delay FROM r WHERE i = 1
      UNION ALL SELECT r.user_id, r.event_id, r.i, r.size, CASE WHEN r.active THEN 600.0 WHEN w.delay >= 2000 THEN 2000.0 WHEN r.size <> w.size THEN 600.0 ELSE greatest(least(w.delay * 1.5, 2000.0), 600.0) END FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
    SELECT user_id, event_id, round(delay, 6) AS delay FROM w"""
)
def rescan_delay(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") / 50).alias("size"), (F.col("event_type") == "purchase").alias("active"))
    return A.rescan_delay(e, "user_id", ["ts", "event_id"], "size", "active", 1.5, 600.0, 2000.0).select("user_id", "event_id", F.round("delay", 6).alias("delay"))


@query(
    """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT (SELECT max(ts) FROM events) + INTERVAL 10 DAY AS now)
    SELECT user_id, CASE WHEN now - last > INTERVAL 264 HOUR THEN 'ERASE' WHEN now - last > INTERVAL 252 HOUR THEN 'NOTIFY' WHEN now - last > INTERVAL 246 HOUR THEN 'NOTE' ELSE 'ACTIVE' END AS state FROM l, n"""
)
def inactivity_states(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = e.agg((F.max("ts") + F.expr("interval 10 days")).alias("now"))
    return A.inactivity_state(last.crossJoin(F.broadcast(now)), "last", "now", 246, 252, 264).select("user_id", "state")
