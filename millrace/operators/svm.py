"""Linear classification on sparse rows (id, label, idx, value), indexes from 1."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, ProbabilisticClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut
from millrace.plans.running import running


def feature_dictionary(features: DataFrame, name: str, order: str) -> DataFrame:
    """(feature, idx): names numbered from 1 by first occurrence."""
    first = features.groupBy(F.col(name).alias("feature")).agg(F.min(order).alias("first"))
    return running(first, [F.col("first"), F.col("feature")], "idx").select("feature", (F.col("idx") + 1).alias("idx"))


def training_set(*classes: DataFrame) -> DataFrame:
    """All classes' rows, labelled by their place in the argument list."""
    out = classes[0].withColumn("label", F.lit(0.0))
    for i, c in enumerate(classes[1:], 1):
        out = out.unionByName(c.withColumn("label", F.lit(float(i))))
    return out


def feature_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.countDistinct("idx").alias("n_features"))


def fit_scale(entries: DataFrame, n_rows: int) -> DataFrame:
    """(idx, low, high) over all rows; a row without an entry counts as 0."""
    out = entries.groupBy("idx").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    absent = F.col("n") < n_rows
    return out.select("idx", F.when(absent, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"), F.when(absent, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"))


#: features up to which their ranges are sent to every task (some 30 bytes each)
MOST_SENT = 100_000


def apply_scale(entries: DataFrame, ids: DataFrame, scale: DataFrame, lower: float = -1.0, upper: float = 1.0) -> DataFrame:
    """(id, idx, value): entries, and the zeros of absent ones, mapped to [lower, upper] by each feature's range.

    Constant and unknown features are dropped, and so are zeros of the result. Nothing is clamped. Entries meet
    their feature's range by a join; only features that map zero elsewhere, whose result has an entry in
    every row, are paired with all rows.
    """
    scale = cut(scale.where("high > low"))
    to = lambda v: F.when(v == F.col("low"), F.lit(lower)).when(v == F.col("high"), F.lit(upper)).otherwise(lower + (upper - lower) * (v - F.col("low")) / (F.col("high") - F.col("low")))
    present = entries.select("id", "idx", "value").join(scale, "idx").select("id", "idx", to(F.col("value")).alias("value"))
    zero = scale.select("idx", to(F.lit(0.0)).alias("value")).where("value <> 0")
    absent = ids.select("id").crossJoin(F.broadcast(zero) if zero.count() <= MOST_SENT else zero)
    absent = absent.join(entries.select("id", "idx"), ["id", "idx"], "left_anti")
    return present.unionByName(absent).where("value <> 0")


def explain(entries: DataFrame, weights: DataFrame, sign: float = 1.0) -> DataFrame:
    """(id, idx, weight, share): each feature's part in a row's decision, as a share of the absolute sum."""
    part = entries.join(weights, "idx").select("id", "idx", (F.col("coefficient") * F.col("value") * sign).alias("weight"))
    total = F.sum(F.abs("weight")).over(Window.partitionBy("id"))
    return part.withColumn("share", F.col("weight") / total)


def by_weight(explained: DataFrame) -> DataFrame:
    """``explained`` with ``place``: each row's features by falling signed weight, equal ones by idx, from 1."""
    return explained.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "idx")))


def confidence(explained: DataFrame) -> DataFrame:
    """(id, total, absolute, confidence): 50 plus the share of the sum in the absolute sum in whole percent, 100 at most."""
    out = explained.groupBy("id").agg(F.sum("weight").alias("total"), F.sum(F.abs("weight")).alias("absolute"))
    share = F.expr("cast(total / absolute * 100 as bigint)")
    return out.withColumn("confidence", 50 + F.least(F.when(F.col("absolute") == 0, F.lit(0)).otherwise(share), F.lit(50)))


def number_text(v: Column) -> Column:
    """At most five decimals, no trailing zeros, no grouping."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.5f", F.bround(v, 5)), "0+$", ""), r"\.$", "")


def arff_lines(rows: DataFrame, n_features: int, positive_only: bool = True) -> DataFrame:
    """(id, line): sparse ARFF data lines of rows (id, cls, entries array of (idx, value) by idx).

    ``positive_only`` leaves out entries that are not above zero, as the format's original writer does.
    """
    keep = F.filter("entries", lambda e: e["value"] > 0) if positive_only else F.col("entries")
    cells = F.transform(keep, lambda e: F.concat_ws(" ", e["idx"].cast("string"), number_text(e["value"])))
    return rows.select("id", F.concat(F.lit("{"), F.array_join(cells, ","), F.lit(f",{n_features + 1} class"), F.col("cls").cast("string"), F.lit("}")).alias("line"))


def arff_header(relation: str, features: list[str], n_classes: int) -> str:
    for a, b in (("'", "QUOTE"), (",", "KOMMA"), ("%", "PERCENT"), ('"', "DOUBLEQUOTE")):
        features = [f.replace(a, b) for f in features]
    names = "".join(f"@attribute {f} numeric\n" for f in features)
    return f"@relation {relation}\n\n{names}@attribute class {{{','.join(f'class{i}' for i in range(n_classes))}}}\n\n@data\n"


def train_linear(rows: DataFrame, features: str = "features", c: float = 100.0):
    """A linear support-vector model; ``rows`` has label (0 or 1) and a vector column."""
    return LinearSVC(featuresCol=features, labelCol="label", regParam=1.0 / (c * max(1, rows.count())), maxIter=50).fit(rows)


def train_probabilities(rows: DataFrame, features: str = "features", c: float = 100.0):
    """A linear model with class probabilities (logistic regression); ``rows`` has label (0, 1, ...) and a vector column."""
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=1.0 / (c * max(1, rows.count())), maxIter=50).fit(rows)


def probabilities(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` and ``probabilities``, an array with one entry a class."""
    if not isinstance(model, ProbabilisticClassificationModel):
        raise ValueError("the model has no probabilities")
    return model.transform(rows).withColumn("probabilities", vector_to_array(model.getProbabilityCol())).drop(model.getProbabilityCol(), model.getRawPredictionCol())


def accessors(model) -> dict:
    """What a model holds: number of classes and features, labels, weights, intercept and parameters."""
    return {
        "n_classes": model.numClasses, "labels": [float(i) for i in range(model.numClasses)], "n_features": model.numFeatures,
        "weights": model.coefficients.toArray().tolist(), "intercept": model.intercept, "parameters": {p.name: v for p, v in model.extractParamMap().items()},
    }


def weight_table(model, spark: SparkSession) -> DataFrame:
    """(idx, coefficient) of a two-class model, indexes from 1, as ``explain`` wants them; bounded by the features."""
    return spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(model.coefficients.toArray())], "idx int, coefficient double")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A saved model of either kind."""
    kind = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())["class"].rsplit(".", 1)[-1]
    kinds = {"LinearSVCModel": LinearSVCModel, "LogisticRegressionModel": LogisticRegressionModel}
    if kind not in kinds:
        raise ValueError(f"{path} holds a {kind}")
    return kinds[kind].load(path)


def save_table(table: DataFrame, path: str) -> None:
    """A feature dictionary or scale, in place of what was there."""
    table.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vectors(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def cross_validate(rows: DataFrame, id_col: str, folds: int = 10, c: float = 100.0) -> tuple[DataFrame, list]:
    """((id, label, prediction) with each row predicted by the model that did not see it, the models)."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col)), F.lit(folds)))
    out, models = None, []
    for k in range(folds):
        test = dealt.where(F.col("fold") == k)
        model = train_linear(dealt.where(F.col("fold") != k), c=c)
        part = model.transform(test).select(id_col, "label", "prediction")
        out = part if out is None else out.unionByName(part)
        models.append(model)
    return out, models


def correct(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count_if(F.col("label") == F.col("prediction")).alias("n_correct"), F.count("*").alias("n"))
