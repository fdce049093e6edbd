"""Sampling design. Market segments are strata and customers are cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..registry import query, table


def cells(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("area"))


_U = "('0x'||substr(md5('{0}:'||c_custkey),1,8))::BIGINT"
_SIZES = "WITH n AS (SELECT c_mktsegment AS stratum, count(*) AS n, sum(c_acctbal) AS area FROM customer GROUP BY 1), z AS (SELECT stratum, n, area, cast(floor(40.0 * n / sum(n) OVER () + 0.5) AS INTEGER) AS size FROM n)"
_DRAW = f", r AS (SELECT c_mktsegment AS stratum, c_custkey AS cell, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_U.format('1')}, {_U.format('1/tie')}, c_custkey) AS k FROM customer), draw AS (SELECT r.stratum, cell FROM r JOIN z USING (stratum) WHERE k <= size)"


def sizes(spark, d):
    n = cells(spark, d).groupBy("stratum").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("stratum", "area", F.floor(40.0 * F.col("n") / F.col("total") + 0.5).cast("int").alias("size"))


def drawn(spark, d):
    return S.stratified_random(cells(spark, d), "stratum", sizes(spark, d).select("stratum", "size"), ["cell"], "1")


@query(f"{_SIZES} SELECT stratum, size FROM z")
def allocation_proportional(spark, d):
    return sizes(spark, d).select("stratum", "size")


@query(f"{_SIZES}{_DRAW} SELECT stratum, cell FROM draw")
def stratified_random_sample(spark, d):
    return drawn(spark, d).select("stratum", "cell")


@query(
    f"""{_SIZES}{_DRAW}, a AS (SELECT stratum, count(*) AS actual FROM draw GROUP BY 1), t AS (SELECT sum(area) AS total FROM z)
    SELECT draw.stratum, cell, size AS requested, actual, round(area/total,8) AS weight, round(area/actual,4) AS expansion_area, round(area/total/actual,10) AS sample_weight FROM draw JOIN z USING (stratum) JOIN a USING (stratum), t"""
)
def sample_enrichment(spark, d):
    out = S.enrich(drawn(spark, d).select("stratum", "cell"), sizes(spark, d), "stratum")
    return out.select("stratum", "cell", F.col("size").alias("requested"), "actual", F.round("weight", 8).alias("weight"), F.round("expansion_area", 4).alias("expansion_area"), F.round("sample_weight", 10).alias("sample_weight"))


@query(
    f"""{_SIZES}, c AS (SELECT c_mktsegment AS stratum, count(*) AS actual FROM customer WHERE c_acctbal < 0 GROUP BY 1)
    SELECT stratum, size, actual, CASE WHEN coalesce(actual,0) < 2 THEN 'BELOW_STATISTICAL_MINIMUM' WHEN coalesce(actual,0) < 5 THEN 'BELOW_CONFIGURED_MINIMUM' WHEN coalesce(actual,0) < size THEN 'BELOW_REQUESTED' ELSE 'VALID' END AS verdict FROM z LEFT JOIN c USING (stratum)"""
)
def final_count_classification(spark, d):
    actual = cells(spark, d).where("area < 0").groupBy("stratum").agg(F.count("*").alias("actual"))
    return S.classify_counts(sizes(spark, d).select("stratum", "size").join(actual, "stratum", "left"), 2, 5)


# Lattices of 2^n times the diameter, enumerated: their rows are every 2^n-th one, their points lie 2^(n+1) half steps apart, those of
# odd rows shifted by half of that. A point's level is the coarsest it is in, and a half more in even rows of that.
_LEVEL = "list_max([n + CASE WHEN (j >> n) % 2 = 0 THEN 0.5 ELSE 0 END FOR n IN range(0, 5) IF j % (1 << n) = 0 AND (2 * i + j % 2 - ((j >> n) % 2) * (1 << n)) % (2 << n) = 0])"


@query(f"SELECT c_custkey AS cell, {_LEVEL}::DOUBLE AS level FROM (SELECT c_custkey, c_custkey % 37 AS i, c_custkey % 101 AS j FROM customer)")
def nested_levels(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell"), S.lattice_level(F.col("c_custkey") % 37, F.col("c_custkey") % 101).alias("level"))


_LC = f"l AS (SELECT c_mktsegment AS stratum, {_LEVEL}::DOUBLE AS level FROM (SELECT c_mktsegment, c_custkey % 37 AS i, c_custkey % 101 AS j FROM customer)), k AS (SELECT stratum, level, count(*) AS n, sum(count(*)) OVER (PARTITION BY stratum ORDER BY level DESC)::BIGINT AS cumulative FROM l GROUP BY 1, 2)"


def _levels(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum"), S.lattice_level(F.col("c_custkey") % 37, F.col("c_custkey") % 101).alias("level"))
    return S.level_counts(c, "stratum", "level")


@query(f"WITH {_LC} SELECT * FROM k")
def systematic_level_counts(spark, d):
    return _levels(spark, d)


@query(f"{_SIZES}, {_LC}, x AS (SELECT k.*, cumulative - size AS diff FROM k JOIN z USING (stratum) WHERE cumulative >= size) SELECT stratum, level, diff AS difference FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY diff, level) AS r FROM x) WHERE r = 1")
def systematic_level_choice(spark, d):
    return S.choose_level(_levels(spark, d), "stratum", "level", sizes(spark, d).select("stratum", "size"))


@query(
    """WITH b AS (SELECT n_nationkey AS id, n_nationkey*10.0 AS x0, n_nationkey*5.0 AS y0, n_nationkey*10.0+60 AS x1, n_nationkey*5.0+40 AS y1 FROM nation), r AS (SELECT *, unnest(generate_series(ceil(y0/6.0)::BIGINT, floor(y1/6.0)::BIGINT)) AS j FROM b),
    s AS (SELECT *, (j % 2) * (4*sqrt(3)/2) AS sh FROM r), t AS (SELECT *, unnest(generate_series(ceil((x0-sh)/(4*sqrt(3)))::BIGINT, floor((x1-sh)/(4*sqrt(3)))::BIGINT)) AS i FROM s) SELECT id, i, j, round(i*(4*sqrt(3))+sh,6) AS x, round(j*6.0,6)::DOUBLE AS y FROM t"""
)
def systematic_lattice(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(k.alias("id"), (k * 10.0).alias("x0"), (k * 5.0).alias("y0"), (k * 10.0 + 60).alias("x1"), (k * 5.0 + 40).alias("y1"))
    return S.lattice(boxes, 4.0).select("id", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT stratum, cell FROM (SELECT c_mktsegment AS stratum, c_custkey AS cell, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x'||substr(md5('s:'||c_custkey),1,8))::BIGINT, c_custkey) AS k FROM customer) WHERE k <= 5")
def image_sample_per_class(spark, d):
    from ..operators.design import sample_classes

    return sample_classes(cells(spark, d), "stratum", 5, ["cell"], "s").select("stratum", "cell")


@query("SELECT n_name, s.missing FROM (SELECT n_nationkey, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS missing FROM nation) s JOIN nation USING (n_nationkey)")
def stratum_set_checks(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return n.join(s, n["n_nationkey"] == F.col("k"), "left").select("n_name", F.col("k").isNull().alias("missing"))
