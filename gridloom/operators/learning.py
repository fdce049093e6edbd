"""Supervised and unsupervised classification of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFIERS = {
    "RANDOM_FOREST": lambda **o: RandomForestClassifier(seed=1, **o),
    "GRADIENT_TREE_BOOST": lambda **o: OneVsRest(classifier=GBTClassifier(seed=1, **o)),
    "CART": lambda **o: DecisionTreeClassifier(seed=1, **o),
    "NAIVE_BAYES": lambda **o: NaiveBayes(**o),
    "SVM": lambda **o: OneVsRest(classifier=LinearSVC(**o)),
}
REGRESSORS = {"RANDOM_FOREST": RandomForestRegressor, "GRADIENT_TREE_BOOST": GBTRegressor, "CART": DecisionTreeRegressor}


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)


def _masked_too(found: DataFrame, pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """``found`` with the pixels that have a masked feature, whose result is masked."""
    masked = F.lit(False)
    for f in features:
        masked = masked | F.col(f).isNull()
    return found.unionByName(pixels.where(masked), allowMissingColumns=True)


def classify(train: DataFrame, pixels: DataFrame, features: Sequence[str], label: str, kind: str, **options) -> DataFrame:
    """``pixels`` with ``class`` and, where the classifier has probabilities, ``class_probability`` in percent.

    Pixels with a masked feature stay, with a masked class; such training rows teach nothing.
    """
    made = CLASSIFIERS[kind](**options)
    if not isinstance(made, OneVsRest):
        made = made.setFeaturesCol("_features").setLabelCol(label)
        out = made.fit(_assembled(train, features)).transform(_assembled(pixels, features))
        best = F.round(100 * F.array_max(vector_to_array("probability"))).cast("int")
        return _masked_too(out.select(*pixels.columns, F.col("prediction").cast("int").alias("class"), best.alias("class_probability")), pixels, features)
    made = made.setFeaturesCol("_features").setLabelCol(label)
    out = made.fit(_assembled(train, features)).transform(_assembled(pixels, features))
    return _masked_too(out.select(*pixels.columns, F.col("prediction").cast("int").alias("class")), pixels, features)


def regress(train: DataFrame, pixels: DataFrame, features: Sequence[str], target: str, kind: str, **options) -> DataFrame:
    model = REGRESSORS[kind](featuresCol="_features", labelCol=target, seed=1, **options).fit(_assembled(train, features))
    found = model.transform(_assembled(pixels, features)).select(*pixels.columns, F.col("prediction").alias("regression"))
    return _masked_too(found, pixels, features)


def minimum_distance(train: DataFrame, pixels: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Class of the nearest class mean; equal distances go to the smaller class. A row for each class is broadcast."""
    means = train.groupBy(F.col(label).alias("_class")).agg(*(F.avg(f).alias(f"_m_{f}") for f in features))
    table = means.agg(F.collect_list(F.struct("_class", F.array(*(F.col(f"_m_{f}") for f in features)).alias("m"))).alias("_means"))
    point = F.array(*(F.col(f) for f in features))
    far = F.transform("_means", lambda c: F.struct(F.round(F.aggregate(F.zip_with(c["m"], point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), 9).alias("d"), c["_class"].alias("c")))
    return pixels.join(F.broadcast(table)).withColumn("class", F.array_min(far)["c"]).drop("_means")


def cluster(pixels: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``cluster`` of each pixel by k-means, numbered by the clusters' mean of the first feature (no sampled pixel decides).

    Pixels with a masked feature stay, with a masked cluster.
    """
    vectors = _assembled(pixels, features)
    found = KMeans(k=k, seed=1, featuresCol="_features", predictionCol="_raw").fit(vectors).transform(vectors).drop("_features")
    means = found.groupBy("_raw").agg(F.avg(features[0]).alias("_mean"))
    rows = means.agg(F.array_sort(F.collect_list(F.struct("_mean", "_raw"))).alias("_order"))
    place = F.array_position(F.transform("_order", lambda s: s["_raw"]), F.col("_raw")) - 1
    found = found.join(F.broadcast(rows)).withColumn("cluster", place.cast("int")).drop("_raw", "_order")
    return _masked_too(found, pixels, features)


def rules(tree: dict) -> F.Column:
    """A decision tree ``{test, yes, no}`` (SQL tests; leaves are classes) as one expression."""
    return F.lit(tree) if not isinstance(tree, dict) else F.when(F.expr(tree["test"]), rules(tree["yes"])).otherwise(rules(tree["no"]))


def mapped_class(row_filter: F.Column | None, mapping: dict, column: str, default: int | None = None) -> F.Column:
    """The class of a training row by the value of one column; rows that the filter leaves out, and values without a class, have the default."""
    out = F.lit(default).cast("int")
    for value, cls in mapping.items():
        out = F.when(F.col(column) == value, F.lit(cls)).otherwise(out)
    return out if row_filter is None else F.when(row_filter, out)


def one_hot_class(columns: dict[str, int], default: int | None = None) -> F.Column:
    """The class whose column is set (not 0), the first of several."""
    out = F.lit(default).cast("int")
    for column, cls in reversed(columns.items()):
        out = F.when(F.coalesce(F.col(column) != 0, F.lit(False)), F.lit(cls)).otherwise(out)
    return out


def next_points(pixels: DataFrame, cls: str, probability: str, keys: Sequence[str], seed: str, most: float = 75, n: int = 5) -> DataFrame:
    """``n`` pixels of each class among those of a probability below ``most`` per cent, by a seeded rank."""
    from .design import sample_classes

    return sample_classes(pixels.where(F.col(probability) < most), cls, n, keys, seed)
