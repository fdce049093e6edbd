"""Classification, regression and clustering of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..registry import query, table

FEATURES = [f"f{i}" for i in range(6)]
_E = "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(6)) + " FROM embeddings"


def pixels(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)))


@query(
    f"""WITH e AS ({_E}), m AS (SELECT label AS c, {', '.join(f'avg({f}) AS m{f}' for f in FEATURES)} FROM e WHERE vec_id % 2 = 0 GROUP BY 1),
    x AS (SELECT vec_id, c, round({' + '.join(f'(m{f}-{f})*(m{f}-{f})' for f in FEATURES)},9) AS far FROM e, m)
    SELECT vec_id, c AS class FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, c) AS r FROM x) WHERE r = 1"""
)
def classification_minimum_distance(spark, d):
    p = pixels(spark, d)
    return L.minimum_distance(p.where("vec_id % 2 = 0"), p, FEATURES, "label").select("vec_id", "class")


@query(f"SELECT vec_id, CASE WHEN f0 > 0 THEN CASE WHEN f1 > 0.1 THEN 1 ELSE 2 END ELSE CASE WHEN f2 < 0 THEN 3 ELSE 4 END END AS class FROM ({_E})")
def classification_decision_tree(spark, d):
    tree = {"test": "f0 > 0", "yes": {"test": "f1 > 0.1", "yes": 1, "no": 2}, "no": {"test": "f2 < 0", "yes": 3, "no": 4}}
    return pixels(spark, d).select("vec_id", L.rules(tree).alias("class"))


def _classifier(name: str, kind: str, **options) -> None:
    def run(spark, d):
        p = pixels(spark, d)
        if kind == "NAIVE_BAYES":
            p = p.select("vec_id", "label", *((F.col(f) + 10).alias(f) for f in FEATURES))
        out = L.classify(p.where("vec_id % 2 = 0"), p, FEATURES, "label", kind, **options)
        return out.select("vec_id", "label", *(c for c in ("class", "class_probability") if c in out.columns))

    run.__name__ = name
    query()(run)


_classifier("classification_random_forest", "RANDOM_FOREST", numTrees=20)
_classifier("classification_cart", "CART")
_classifier("classification_naive_bayes", "NAIVE_BAYES")
_classifier("classification_svm", "SVM", maxIter=2)


@query()
def regression_random_forest(spark, d):
    p = pixels(spark, d)
    return L.regress(p.where("vec_id % 2 = 0"), p, FEATURES[1:], "f0", "RANDOM_FOREST", numTrees=10).select("vec_id", "regression")


@query()
def unsupervised_kmeans(spark, d):
    return L.cluster(pixels(spark, d), FEATURES, 5).select("vec_id", "cluster")


@query(f"WITH e AS ({_E}) SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x'||substr(md5('n:'||vec_id),1,8))::BIGINT, vec_id) AS r FROM e WHERE f0 < 0.05) WHERE r <= 5")
def active_learning_points(spark, d):
    from pyspark.sql import Window

    from ..functions.hashing import uniform

    w = Window.partitionBy("label").orderBy(uniform("n", F.col("vec_id")), "vec_id")
    return pixels(spark, d).where("f0 < 0.05").withColumn("r", F.row_number().over(w)).where("r <= 5").select("vec_id", "label")


@query(
    """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2, embedding[4]::DOUBLE AS f3, embedding[5]::DOUBLE AS f4, embedding[6]::DOUBLE AS f5 FROM embeddings),
    t AS (SELECT vec_id % 20 AS cell, avg(f0) AS f0 FROM e GROUP BY 1) SELECT l.doc_id, l.quality, round(t.f0, 8) AS f0 FROM labels l JOIN t ON l.doc_id % 20 = t.cell"""
)
def training_points_join(spark, d):
    cell = pixels(spark, d).groupBy((F.col("vec_id") % 20).alias("cell")).agg(F.avg("f0").alias("f0"))
    points = table(spark, d, "labels").withColumn("cell", F.col("doc_id") % 20)
    return points.join(cell, "cell").select("doc_id", "quality", F.round("f0", 8).alias("f0"))
