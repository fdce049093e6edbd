"""Sampling design, second half. Market segments are strata, customers are cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import sampling as S
from ..registry import query, table
from .sampling import _LC, _SIZES, cells, sizes

_W = "n AS (SELECT c_mktsegment AS stratum, count(*) * 1.0 / (SELECT count(*) FROM customer) AS w, 0.1 + 0.1 * row_number() OVER (ORDER BY c_mktsegment) AS p FROM customer GROUP BY 1)"
_CV = "sqrt(p * (1 - p)) / p"


def weights(spark, d) -> list[tuple[str, float, float]]:
    """(stratum, weight, proportion) of a handful of strata, on the driver."""
    n = cells(spark, d).groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()
    total = sum(r["n"] for r in n)
    return [(r["stratum"], r["n"] / total, 0.1 + 0.1 * (i + 1)) for i, r in enumerate(n)]


_STRATEGIES = ("EQUAL", "PROPORTIONAL", "POWER", "OPTIMAL", "BALANCED")
_BASE = f"""t AS (SELECT unnest(generate_series(60, 103)) AS m),
 b AS (SELECT m, stratum, w, p, row_number() OVER (PARTITION BY m ORDER BY stratum) AS i, ceil(m / 5.0) AS equal, floor(m * w + 0.5) AS proportional, {_CV} * pow(w * p, 0.5) AS tp, {_CV} * (w * p) AS t1 FROM n, t),
 s AS (SELECT 'EQUAL' AS strategy, m, stratum, i, equal AS size FROM b UNION ALL SELECT 'PROPORTIONAL', m, stratum, i, proportional FROM b UNION ALL SELECT 'BALANCED', m, stratum, i, floor((equal + proportional) / 2 + 0.5) FROM b
   UNION ALL SELECT 'POWER', m, stratum, i, floor(m * tp / sum(tp) OVER (PARTITION BY m) + 0.5) FROM b UNION ALL SELECT 'OPTIMAL', m, stratum, i, floor(m * t1 / sum(t1) OVER (PARTITION BY m) + 0.5) FROM b),
 z AS (SELECT strategy, m, sum(size) AS total FROM s GROUP BY 1, 2),
 walk AS (SELECT strategy, 103::BIGINT AS m FROM z WHERE m = 103 UNION ALL SELECT strategy, (m - (total - 103))::BIGINT FROM walk JOIN z USING (strategy, m) WHERE total > 103),
 last AS (SELECT strategy, min(m) AS m FROM walk GROUP BY 1)"""


@query(f"WITH RECURSIVE {_W}, {_BASE} SELECT strategy, stratum, (size + CASE WHEN i <= 103 - total THEN 1 ELSE 0 END)::BIGINT AS size FROM last JOIN s USING (strategy, m) JOIN z USING (strategy, m)")
def allocation_strategies(spark, d):
    w = weights(spark, d)
    rows = []
    for strategy in _STRATEGIES:
        made = S.allocate(103, [x[1] for x in w], strategy, [x[2] for x in w], 1, 0.5)
        rows += [(strategy, name, n) for (name, _, _), n in zip(w, made, strict=True)]
    return spark.createDataFrame(rows, "strategy string, stratum string, size long")


_Z = 1.959963984540054
_ROOT = "sqrt(greatest({z}*{z} - 1/n + 4*n*p*(1-p) {s} (4*p-2), 0))"
_LOW = "greatest((2*n*p + {z}*{z} - ({z}*" + _ROOT.replace("{s}", "+") + " + 1)) / (2*(n + {z}*{z})), 0)"
_HIGH = "least((2*n*p + {z}*{z} + ({z}*" + _ROOT.replace("{s}", "-") + " + 1)) / (2*(n + {z}*{z})), 1)"


@query(
    f"""WITH {_W}, k AS (SELECT stratum, w, p, floor(200 * w + 0.5) AS n FROM n), e AS (SELECT w, p, {_LOW.replace('{z}', repr(_Z))} AS lo, {_HIGH.replace('{z}', repr(_Z))} AS hi FROM k),
    t AS (SELECT sum(w * p) AS p, sqrt(sum(pow(w * (p - lo), 2))) AS a, sqrt(sum(pow(w * (hi - p), 2))) AS b FROM e)
    SELECT round(greatest(p - a, 0), 6) AS low, round(p, 6)::DOUBLE AS proportion, round(least(p + b, 1), 6) AS high, round(greatest(a, b) / p, 6) AS margin FROM t"""
)
def confidence_interval(spark, d):
    w = weights(spark, d)
    low, p, high = S.confidence_bounds([(x[1], x[2], int(200 * x[1] + 0.5)) for x in w], 0.95)
    return spark.createDataFrame([(round(low, 6), round(p, 6), round(high, 6), round(S.margin_of_error(low, p, high), 6))], "low double, proportion double, high double, margin double")


@query()
def sample_size_for_margin(spark, d):
    """By bisection; tested against a search of all sizes."""
    w = weights(spark, d)
    rows = [(m, D.sample_size(m, [x[1] for x in w], [x[2] for x in w], 0.95)) for m in (0.1, 0.2, 0.5)]
    return spark.createDataFrame(rows, "margin double, size long")


@query("WITH p AS (SELECT c_mktsegment AS stratum, avg(abs(c_acctbal)) / 100 AS p, count(*) * 1.0 / (SELECT count(*) FROM customer) AS w FROM customer GROUP BY 1) SELECT stratum, round(least(p / 100, 1), 6) AS plain, round(least(p / 100 * 0.25 / (SELECT sum(w * p / 100) FROM p), 1), 6) AS scaled FROM p")
def stratum_proportions(spark, d):
    rows = cells(spark, d).groupBy("stratum").agg((F.avg(F.abs("area")) / 100).alias("p"), F.count("*").alias("n")).orderBy("stratum").collect()
    total = sum(r["n"] for r in rows)
    w, p = [r["n"] / total for r in rows], [r["p"] for r in rows]
    made = zip((r["stratum"] for r in rows), D.proportions(p, w), D.proportions(p, w, 0.25), strict=True)
    return spark.createDataFrame([(s, round(a, 6), round(b, 6)) for s, a, b in made], "stratum string, plain double, scaled double")


_DESIGNS = "g AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'EQUAL' WHEN 'O' THEN 'OPTIMAL' ELSE 'PROPORTIONAL' END AS strategy, CASE WHEN o_orderkey % 4 > 0 THEN substr(o_orderpriority, 1, 1)::INT * 2 - 1 END AS configured, o_orderkey % 3 = 0 AS manual, CASE WHEN o_orderkey % 5 > 0 THEN (o_totalprice / 5000)::INT END AS n FROM orders)"
_LEAST = "CASE WHEN strategy = 'EQUAL' OR manual OR configured IS NULL THEN 2 ELSE greatest(2, configured) END"


def _designs(spark, d):
    """Each order stands for a design: its status for the strategy, its priority for the configured minimum, its price for the size.

    Halves go to the even size, as the cast in the SQL has it.
    """
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    strategy = F.when(F.col("o_orderstatus") == "F", "EQUAL").when(F.col("o_orderstatus") == "O", "OPTIMAL").otherwise("PROPORTIONAL")
    configured = F.when(key % 4 > 0, F.substring("o_orderpriority", 1, 1).cast("int") * 2 - 1)
    return o.select(key.alias("id"), strategy.alias("strategy"), configured.alias("configured"), (key % 3 == 0).alias("manual"), F.when(key % 5 > 0, F.rint(F.col("o_totalprice") / 5000).cast("int")).alias("n"))


@query(f"WITH {_DESIGNS} SELECT id, {_LEAST} AS least FROM g")
def minimum_rule(spark, d):
    return _designs(spark, d).select("id", D.least_samples_column("strategy", "configured", "manual").alias("least"))


@query(f"WITH {_DESIGNS}, k AS (SELECT count(DISTINCT c_mktsegment) AS k FROM customer), s AS (SELECT id, n, CASE WHEN n IS NULL THEN 'MARGIN_UNREACHABLE' WHEN n < k * ({_LEAST}) THEN 'SAMPLE_TOO_SMALL' ELSE 'OK' END AS status FROM g, k) SELECT id, status, CASE WHEN status = 'OK' THEN n ELSE 0 END::INT AS total FROM s")
def allocation_outcomes(spark, d):
    """Designs over the market segments, each allocated to them by its strategy: the sizes add up to the sample."""
    w = weights(spark, d)
    least = D.least_samples_column("strategy", "configured", "manual")
    out = D.outcomes(_designs(spark, d), [x[1] for x in w], [x[2] for x in w], "n", "strategy", least)
    return out.select("id", "status", F.aggregate("sizes", F.lit(0), lambda a, b: a + b).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, count(*) = count(DISTINCT c_custkey) AS intact FROM customer")
def sample_integrity(spark, d):
    return D.integrity(cells(spark, d), "cell")


@query("WITH r AS (SELECT c_custkey AS cell, row_number() OVER (ORDER BY ('0x'||substr(md5('u:'||c_custkey),1,8))::BIGINT, ('0x'||substr(md5('u/tie:'||c_custkey),1,8))::BIGINT, c_custkey) - 1 AS index FROM customer) SELECT cell, index, cell || '_' || index AS id FROM r WHERE index < 50")
def unstratified_random_sample(spark, d):
    return D.unstratified_random(cells(spark, d), 50, ["cell"], "u").select("cell", "index", "id")


@query(f"{_SIZES}, {_LC}, x AS (SELECT z.stratum, level, cumulative - size AS diff FROM z LEFT JOIN k USING (stratum)) SELECT stratum, coalesce(level, -1) AS level, abs(diff) AS difference FROM x QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY abs(diff), level) = 1")
def systematic_level_closest(spark, d):
    from .sampling import _levels

    return S.choose_level(_levels(spark, d), "stratum", "level", sizes(spark, d).select("stratum", "size"), "CLOSEST")


@query(f"{_SIZES}, {_LC}, w AS (SELECT stratum, CASE WHEN stratum = 'MACHINERY' THEN 1000000 ELSE size END AS size FROM z), x AS (SELECT w.stratum, level, CASE WHEN cumulative >= size THEN cumulative - size END AS diff FROM w LEFT JOIN k USING (stratum)) SELECT stratum, coalesce(arg_min(level, (diff, level)) FILTER (WHERE diff IS NOT NULL), -1) AS level, min(diff) AS difference FROM x GROUP BY 1")
def systematic_level_short(spark, d):
    from .sampling import _levels

    wanted = sizes(spark, d).select("stratum", F.when(F.col("stratum") == "MACHINERY", 1_000_000).otherwise(F.col("size")).alias("size"))
    return S.choose_level(_levels(spark, d), "stratum", "level", wanted)


@query(
    f"""{_SIZES}, {_LC}, x AS (SELECT z.stratum, level, cumulative - size AS diff FROM z JOIN k USING (stratum) WHERE cumulative >= size), ch AS (SELECT stratum, arg_min(level, (diff, level)) AS least FROM x GROUP BY 1),
    c AS (SELECT c_mktsegment AS stratum, c_custkey AS cell, c_custkey % 37 AS i, c_custkey % 101 AS j FROM customer), e AS (SELECT stratum, cell, {{level}} AS level FROM c),
    q AS (SELECT e.stratum, cell, size, row_number() OVER (PARTITION BY e.stratum ORDER BY ('0x'||substr(md5('x:'||cell),1,8))::BIGINT, cell) AS r FROM e JOIN ch USING (stratum) JOIN z USING (stratum) WHERE level >= least) SELECT stratum, cell FROM q WHERE r <= size""".replace(
        "{level}", _LC.split("c_mktsegment AS stratum, ")[1].split("::DOUBLE AS level")[0]
    )
)
def systematic_exact_sample(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("cell"), S.lattice_level(F.col("c_custkey") % 37, F.col("c_custkey") % 101).alias("level"))
    wanted = sizes(spark, d).select("stratum", "size")
    chosen = S.choose_level(S.level_counts(c, "stratum", "level"), "stratum", "level", wanted, "EXACT")
    return D.exact_sample(c, chosen, "stratum", "level", wanted, "x", ["cell"]).select("stratum", "cell")


_COUNTS = "k AS (SELECT n_name AS stratum, 20 * (1 + n_nationkey % 13) AS requested, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 400 * n_nationkey) AS raw, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 5 - 1 END AS finest FROM nation)"


def _counts(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    raw = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("c_acctbal") > 400 * F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("raw"))
    key = F.col("n_nationkey")
    return n.join(raw, F.col("k") == key, "left").select(F.col("n_name").alias("stratum"), (20 * (1 + key % 13)).alias("requested"), "raw", F.when(key % 5 > 0, key % 5 - 1).alias("finest"))


_OFFSETS = f"""{_COUNTS}, e AS (SELECT *, CASE WHEN raw >= requested THEN 0 ELSE (SELECT min(x) FROM generate_series(0, 30) g(x) WHERE greatest(raw, 1) * pow(4, x) >= requested) END AS extra FROM k),
    o AS (SELECT stratum, raw < requested AS short, extra::INT AS extra, CASE WHEN raw < requested THEN least(extra + 1, coalesce(finest, 99)) ELSE 0 END::INT AS target, raw >= requested OR coalesce(finest, 99) > 0 AS repairable FROM e)"""


@query(f"WITH {_OFFSETS} SELECT * FROM o")
def repair_offsets(spark, d):
    """Nations are strata, their customers of enough balance candidates: some have none, some cannot be made denser."""
    return D.repair_offsets(_counts(spark, d))


@query(f"WITH {_OFFSETS} SELECT max(target) AS target, count_if(NOT repairable)::BIGINT AS beyond_repair FROM o")
def repair_offset(spark, d):
    return D.repair_offset(D.repair_offsets(_counts(spark, d)))


_U = "('0x' || substr(md5('origin:' || n_name || ':{}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT n_name AS stratum, round({_U.format('x')} * (100 + n_nationkey), 9) AS phase_x, round({_U.format('y')} * (100 + n_nationkey), 9) AS phase_y, floor({_U.format('i')} * 16)::INT AS phase_i, floor({_U.format('j')} * 32)::INT AS phase_j FROM nation")
def origin_phases(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("stratum"), (F.lit(100.0) + F.col("n_nationkey")).alias("step"))
    out = D.origin_phases(n, "stratum", "step")
    return out.select("stratum", F.round("phase_x", 9).alias("phase_x"), F.round("phase_y", 9).alias("phase_y"), "phase_i", "phase_j")


@query()
def candidate_lattices(spark, d):
    """Points of nested lattices of two densities; tested against lattices made directly."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    boxes = n.select(k.alias("stratum"), (k * 10.0).alias("x0"), (k * 5.0).alias("y0"), (k * 10.0 + 60).alias("x1"), (k * 5.0 + 40).alias("y1"))
    return D.candidates(boxes, n.select(k.alias("stratum"), (F.lit(1) + k % 3).cast("int").alias("exponent")), "stratum", 1).select("stratum", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"{_SIZES}, a AS (SELECT c_mktsegment AS stratum, count(*) AS actual FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT stratum, size, coalesce(actual, 0) AS actual, size - coalesce(actual, 0) AS short FROM z LEFT JOIN a USING (stratum) WHERE size > coalesce(actual, 0)")
def sample_shortfalls(spark, d):
    actual = cells(spark, d).where("area > 9000").groupBy("stratum").agg(F.count("*").alias("actual"))
    return D.shortfalls(sizes(spark, d).select("stratum", "size"), actual, "stratum")


@query("SELECT c_mktsegment AS stratum, c_custkey AS cell, 'SYSTEMATIC' AS arrangement, 7 AS seed FROM customer")
def sample_metadata(spark, d):
    return D.with_metadata(cells(spark, d).select("stratum", "cell"), {"arrangement": "SYSTEMATIC", "seed": 7})


@query("WITH g AS (SELECT n_name AS stratum, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1), k AS (SELECT n_name AS stratum FROM nation) SELECT coalesce(g.stratum, k.stratum) AS stratum, CASE WHEN n IS NULL THEN 'MISSING' WHEN k.stratum IS NULL THEN 'UNEXPECTED' ELSE 'DUPLICATE' END AS problem FROM g FULL JOIN k ON g.stratum = k.stratum WHERE n IS NULL OR k.stratum IS NULL OR n > 1")
def allocation_validation(spark, d):
    n = table(spark, d, "nation")
    given = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("stratum"))
    return D.allocation_differences(given, n.select(F.col("n_name").alias("stratum")), "stratum")


@query(
    f"""{_SIZES}, a AS (SELECT c_mktsegment AS stratum, count(*) AS actual FROM customer WHERE c_acctbal > 9000 GROUP BY 1), v AS (SELECT stratum, size, actual, CASE WHEN coalesce(actual,0) < 2 THEN 'BELOW_STATISTICAL_MINIMUM' WHEN coalesce(actual,0) < 5 THEN 'BELOW_CONFIGURED_MINIMUM' WHEN coalesce(actual,0) < size THEN 'BELOW_REQUESTED' ELSE 'VALID' END AS verdict FROM z LEFT JOIN a USING (stratum))
    SELECT verdict, count(*) AS strata, string_agg(stratum, ',' ORDER BY stratum) AS which, sum(size - coalesce(actual, 0))::BIGINT AS lacking FROM v WHERE verdict <> 'VALID' GROUP BY 1"""
)
def underproduction_advice(spark, d):
    actual = cells(spark, d).where("area > 9000").groupBy("stratum").agg(F.count("*").alias("actual"))
    return D.advice(S.classify_counts(sizes(spark, d).select("stratum", "size").join(actual, "stratum", "left"), 2, 5), "stratum")
