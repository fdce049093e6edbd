"""Scene search, sessions, budgets, event history and lists. Orders are scenes of customers; events are a user's history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import accounts, selection
from ..operators import catalog as C
from ..registry import query, table

_SCENES = """SELECT o_custkey AS area, o_orderkey AS scene, o_orderdate AS ts, o_orderkey % 101 AS cloud,
 0.7 * (o_orderkey % 101) / 100 + 0.3 * least(abs(dayofyear(o_orderdate) - 40), 365 - abs(dayofyear(o_orderdate) - 40)) / 182 AS weight FROM orders"""


def scenes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("area"), F.col("o_orderkey").alias("scene"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 101).alias("cloud"))
    return o.withColumn("weight", C.scene_weight(F.col("cloud"), F.dayofyear("ts"), 40, 0.3))


@query(f"SELECT area, scene, rank, round(weight,9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(weight,9), cloud, scene) AS rank FROM ({_SCENES})) WHERE rank <= 3")
def scene_ranking(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("area").orderBy(F.round("weight", 9), "cloud", "scene")
    rows = scenes(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return rows.select("area", "scene", F.col("rank").cast("long").alias("rank"), F.round("weight", 9).alias("weight"))


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(weight,9), cloud, scene) AS rank FROM ({_SCENES})),
    b AS (SELECT *, max((cloud <= 0)::INT) OVER w AS clear, sum(ln(greatest(cloud, 1e-12)/100)) OVER w AS logs FROM s WHERE rank <= 6
      WINDOW w AS (PARTITION BY area ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT area, scene, rank FROM b WHERE rank <= 2 OR (CASE WHEN clear = 1 THEN 0 ELSE coalesce(exp(logs), 1) END) > 0.1"""
)
def best_scenes(spark, d):
    rows = scenes(spark, d).withColumn("w", F.round("weight", 9))
    return C.best_scenes(rows, "area", ["w", "cloud", "scene"], "cloud", 2, 6, 0.1).select("area", "scene", F.col("rank").cast("long").alias("rank"))


@query()
def scene_cover(spark, d):
    rows = scenes(spark, d).select("area", "scene", "cloud", F.explode(F.sequence(F.col("scene") % 4, F.col("scene") % 4 + 2)).alias("cell"))
    return selection.cover_scenes(rows, "area", "scene", "cell", "cloud")


@query()
def scene_round_robin(spark, d):
    """Suppliers are scenes of their nation, buckets of parts the cells that pairs of nations share; tested against a simulation."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene"), F.col("s_nationkey").alias("area"), (F.floor(F.abs("s_acctbal")) % 101).alias("cloud"))
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scene"), (F.col("l_partkey") % 60).alias("part")).distinct()
    rows = cells.join(F.broadcast(s), "scene").select("area", "scene", "cloud", (F.floor(F.col("area") / 2) * 1000 + F.col("part")).alias("cell"))
    return selection.round_robin(rows, "area", "scene", "cell", "cloud", 0.2)


@query("SELECT o_orderkey AS scene FROM orders WHERE (dayofyear(o_orderdate) >= 330 OR dayofyear(o_orderdate) <= 45)")
def season_over_year_end(spark, d):
    return table(spark, d, "orders").where(dates.in_season(F.dayofyear("o_orderdate"), 330, 45)).select(F.col("o_orderkey").alias("scene"))


@query(
    """SELECT o_orderkey AS scene FROM orders WHERE (o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01') OR (o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-06-01')
    OR (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-06-01')"""
)
def seasonal_date_filter(spark, d):
    return table(spark, d, "orders").where(dates.seasonal(F.col("o_orderdate"), "1996-03-01", "1996-06-01", 2, 2)).select(F.col("o_orderkey").alias("scene"))


@query("SELECT month(o_orderdate)::INTEGER AS month, count(*) AS n FROM orders WHERE month(o_orderdate) IN (4, 5) GROUP BY 1")
def calendar_range(spark, d):
    month = F.month("o_orderdate")
    return table(spark, d, "orders").where(month.isin(4, 5)).groupBy(month.alias("month")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS sensor, max(ts) AS updated FROM events GROUP BY 1")
def freshness(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("sensor")).agg(F.max("ts").alias("updated"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark, d):
    return C.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, max(ts) AS closed FROM events WHERE event_type = 'purchase' GROUP BY 1")
def last_closed_session(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("closed"))


_CHANGES = "SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE event_type <> 'error'"


@query(f"SELECT event_id, user_id, event_type FROM ({_CHANGES}) WHERE was IS NULL OR was <> event_type")
def history_change_points(spark, d):
    return C.changes_only(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["error"]).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({_CHANGES}) WHERE was IS NULL OR was <> event_type) WHERE r <= 10")
def history_last_changes(spark, d):
    from pyspark.sql import Window

    rows = C.changes_only(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["error"])
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("r", rank).where("r <= 10").select("event_id", "user_id")


def _sessions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    end = F.coalesce(F.lead("ts").over(w), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.col("ts").alias("start"), end.alias("end"))


_SESSIONS = "SELECT user_id AS user, event_type AS type, ts AS start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01') AS fin FROM events"
_HOURS = "CASE WHEN date_diff('second', greatest(start, TIMESTAMP '2024-01-10'), least(fin, TIMESTAMP '2024-01-20')) > 0 THEN ceil(date_diff('second', greatest(start, TIMESTAMP '2024-01-10'), least(fin, TIMESTAMP '2024-01-20')) / 3600) ELSE 0 END"
_PRICES = "(VALUES ('click', 0.5), ('view', 0.25), ('purchase', 2.0)) AS p(type, price)"


@query(f'SELECT "user", round(sum({_HOURS} * coalesce(price, 0)),4)::DOUBLE AS spending FROM ({_SESSIONS}) LEFT JOIN {_PRICES} USING (type) GROUP BY 1')
def instance_spending(spark, d):
    # seconds only, as both ends are whole seconds of the clock after truncation
    uses = _sessions(spark, d).withColumns({c: F.date_trunc("second", c).cast("timestamp_ntz") for c in ("start", "end")})
    prices = spark.createDataFrame([("click", 0.5), ("view", 0.25), ("purchase", 2.0)], "type string, price double")
    return C.instance_spending(uses, prices, "2024-01-10", "2024-01-20").select("user", F.round("spending", 4).alias("spending"))


@query(
    """WITH x AS (SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS mon, (coalesce(lag(value) OVER w, 0) + value) / 2 * date_diff('second', date_trunc('second', greatest(coalesce(lag(ts) OVER w, date_trunc('month', ts)), date_trunc('month', ts))), date_trunc('second', ts)) / 3600 AS gh
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, mon AS month, round(sum(gh),3) AS gb_hours, round(sum(gh) * 0.3 / day(last_day(mon)) / 24, 5) AS spending FROM x GROUP BY user_id, mon"""
)
def storage_spending(spark, d):
    use = table(spark, d, "events").select("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value")
    out = C.storage_hours(use, "user_id", "ts", "value")
    spent = C.storage_spending(F.col("gb_hours"), 0.3, F.col("month"))
    return out.select("user_id", "month", F.round("gb_hours", 3).alias("gb_hours"), F.round(spent, 5).alias("spending"))


@query(
    """WITH o AS (SELECT c_custkey, c_acctbal AS quota FROM customer WHERE c_custkey % 3 = 0)
    SELECT n.c_custkey AS user, coalesce(o.quota, 100.0) AS quota FROM (SELECT c_custkey FROM customer) n LEFT JOIN o USING (c_custkey)"""
)
def budget_with_default(spark, d):
    c = table(spark, d, "customer")
    own = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("quota"))
    return C.with_defaults(c.select(F.col("c_custkey").alias("user")), own, "user", {"quota": 100.0})


@query("WITH s AS (SELECT o_custkey AS user, round(sum(o_totalprice),2) AS spent FROM orders GROUP BY 1) SELECT user, spent FROM s JOIN customer ON user = c_custkey WHERE spent >= c_acctbal * 400")
def users_exceeding_budget(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    budget = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_acctbal") * 400).alias("budget"))
    return spent.join(budget, "user").where("spent >= budget").select("user", "spent")


@query("SELECT user FROM (SELECT user_id AS user FROM events UNION SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def usernames_union(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("user")) for t, c in (("events", "user_id"), ("customer", "c_custkey"), ("orders", "o_custkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT c.conv_id, c.turn, o.turn AS read_turn FROM conversations c LEFT JOIN conversations o ON c.conv_id = o.conv_id AND c.turn = o.turn AND (o.role = 'user' OR o.role IS NULL)")
def messages_with_notifications(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    n = table(spark, d, "conversations").where("role = 'user' or role is null").select("conv_id", "turn", F.col("turn").alias("read_turn"))
    return c.join(n, ["conv_id", "turn"], "left")


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND ts < TIMESTAMP '2024-01-05') OR (event_type = 'view' AND (ts < TIMESTAMP '2024-01-10' OR ts IS NULL))")
def timed_out_tasks(spark, d):
    old = ((F.col("event_type") == "click") & (F.col("ts") < "2024-01-05")) | ((F.col("event_type") == "view") & ((F.col("ts") < "2024-01-10") | F.col("ts").isNull()))
    return table(spark, d, "events").where(old).select("event_id")


@query(
    """SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_partkey % 50 = 0"""
)
def update_or_insert(spark, d):
    target = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    changes = target.where("id % 10 = 0").select("id", (F.col("size") + 100).alias("size")).unionByName(target.where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), "size"))
    return C.upsert(target, changes, ["id"])


@query(
    """WITH n AS (SELECT l_orderkey AS id, min(l_shipdate) AS ts FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_orderdate AS ts FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT id, ts FROM n WHERE id % 2 <> 0"""
)
def insert_ignore(spark, d):
    target = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"))
    return C.insert_ignore(target, rows, ["id"], ["ts"])


@query("SELECT greatest(coalesce(max(c_custkey),0), (SELECT coalesce(max(s_suppkey),0) FROM supplier)) + 1 AS id FROM customer")
def next_id(spark, d):
    a = table(spark, d, "customer").agg(F.coalesce(F.max("c_custkey"), F.lit(0)).alias("a"))
    b = table(spark, d, "supplier").agg(F.coalesce(F.max("s_suppkey"), F.lit(0)).alias("b"))
    return a.join(F.broadcast(b)).select((F.greatest("a", "b") + 1).alias("id"))


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')) AND (contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ')) ORDER BY p_name, p_partkey LIMIT 10")
def dataset_search(spark, d):
    p = table(spark, d, "part")
    return p.where(text.matches_all(["red", "ECON"], F.col("p_name"), F.col("p_type"))).orderBy("p_name", "p_partkey").limit(10).select("p_partkey", "p_name")


@query("SELECT o_orderkey, n_name, row_number() OVER (ORDER BY n_name, o_orderdate DESC, o_orderkey) AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR n_name LIKE '%A%' ")
def recipe_list(spark, d):
    """Recipes by name, the latest first."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    named = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    rows = o.join(named, F.col("o_custkey") == F.col("c_custkey"), "left").where((F.col("n_name") == "NATION_3") | F.col("n_name").like("%A%"))
    return accounts.placed(rows.select("o_orderkey", "n_name", "o_orderdate"), ["n_name", F.desc("o_orderdate"), "o_orderkey"]).drop("o_orderdate")


@query("SELECT s_name, row_number() OVER (ORDER BY s_suppkey % 4 <> 0, regexp_replace(s_name, '[0-9].*$', ''), lpad(regexp_extract(s_name, '([0-9]+)', 1), 12, '0'), s_name) AS place FROM supplier")
def file_list(spark, d):
    """Folders first, then by the natural order of names."""
    s = table(spark, d, "supplier").select("s_name", (F.col("s_suppkey") % 4 != 0).alias("_file"), text.natural(F.col("s_name")).alias("_key"))
    return accounts.placed(s, ["_file", "_key", "s_name"]).select("s_name", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, event_id, date_diff('second', date_trunc('second', ts), date_trunc('second', n)) AS gap FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE date_diff('second', date_trunc('second', ts), date_trunc('second', n)) > 7200")
def inactivity_gaps(spark, d):
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("n", after)
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", "ts"), F.date_trunc("second", "n"))
    return e.select("user_id", "event_id", gap.alias("gap")).where("gap > 7200")


@query("SELECT user_id, event_id, sum(CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS pending FROM events")
def running_state(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.sum(F.col("event_type").isin("click", "view").cast("int")).over(w)
    return table(spark, d, "events").select("user_id", "event_id", seen.alias("pending"))
