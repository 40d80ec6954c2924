"""Feature preparation, regressions and coefficient summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.operators import dimensions, gram, projection, reshape
from loopweave.operators.sampling import hash_split


@dataclass(frozen=True)
class Result:
    """R² on the held-out rows and one weight per feature, by falling weight."""

    r2: float
    intercept: float
    weights: DataFrame


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation of every listed column; constant columns become 0.

    The statistics are one row, read once and placed as constants.
    """
    row = df.agg(*[fn(c).alias(f"{name}{i}") for i, c in enumerate(columns)
                   for name, fn in (("m", F.avg), ("s", F.stddev_samp))]).first()

    def scaled(i: int, column: str) -> Column:
        mean, std = row[f"m{i}"], row[f"s{i}"]
        if not std:
            return F.when(F.col(column).isNotNull(), 0.0)
        return (F.col(column) - F.lit(float(mean))) / F.lit(float(std))

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(columns)})


def labelled_features(df: DataFrame, label: str, features: list[str],
                      keep: list[str] | None = None) -> DataFrame:
    """(label, features vector); rows with missing values are left out."""
    rows = df.select(*(keep or []), F.col(label).cast("double").alias("label"),
                     *[F.col(f"`{f}`").cast("double").alias(f"_{i}")
                       for i, f in enumerate(features)])
    names = [f"_{i}" for i in range(len(features))]
    assembled = VectorAssembler(inputCols=names, outputCol="features",
                                handleInvalid="skip").transform(rows.dropna(subset=["label"]))
    return assembled.select(*(keep or []), "label", "features")


def _weights(df: DataFrame, features: list[str], values) -> DataFrame:
    pairs = sorted(zip(features, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame(pairs, "feature string, weight double")


def linear_regression(df: DataFrame, label: str, features: list[str], keys: list[str],
                      train: float | None = 0.7, reg_param: float = 0.0,
                      elastic_net: float = 0.5, salt: str = "47") -> Result:
    """Linear regression with an optional elastic-net penalty (none by default).

    Rows go to the training side by key hash; ``train=None`` fits and scores all.
    """
    rows = labelled_features(df, label, features, keys)
    fit_on, score_on = (rows, rows) if train is None else hash_split(rows, keys, train, salt)
    model = LinearRegression(regParam=reg_param, elasticNetParam=elastic_net).fit(fit_on)
    return Result(model.evaluate(score_on).r2, float(model.intercept),
                  _weights(df, features, model.coefficients.toArray()))


def random_forest(df: DataFrame, label: str, features: list[str], keys: list[str],
                  train: float = 0.7, trees: int = 20, depth: int = 5, seed: int = 47,
                  salt: str = "47") -> Result:
    """Random-forest regression; weights are feature importances."""
    from pyspark.ml.evaluation import RegressionEvaluator

    rows = labelled_features(df, label, features, keys)
    fit_on, score_on = hash_split(rows, keys, train, salt)
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(fit_on)
    r2 = RegressionEvaluator(metricName="r2").evaluate(model.transform(score_on))
    return Result(r2, 0.0, _weights(df, features, model.featureImportances.toArray()))


def per_group(df: DataFrame, group: str, values: list, label: str, features: list[str],
              keys: list[str], **options) -> DataFrame:
    """(group, feature, weight, r2): one regression per listed group value, from one scan."""
    found = gram.elastic_nets(df.filter(F.col(group).isin(values)), [group], label, features, keys,
                              **options)
    return found.select(group, "feature", "weight", "r2")


# Columns of the regression extract that do not become features.
DROPPED = ["S_ID", "Flow_Coef_1", "Flow_Coef_2", "Flow_Coef_3", "Flow_Coef_4", "Flow_Coef_5",
           "CHP_DESC", "CHP_DURATION", "CC_CODE", "ZIP"]
ENCODED = ["NUM_LANES", "FWY_NUM", "FWY_DIR", "DAY_OF_WEEK", "DISTRICT_ID"]


def prepare(extract: DataFrame, stations: DataFrame, basis: projection.Basis,
            levels: dict[str, list] | None = None) -> DataFrame:
    """Features for the regression, from the extract and station metadata.

    Adds the mean reconstructed flow, turns the incident flag and the date into
    numbers, and replaces the listed columns by 0/1 columns.
    """
    take = {c: c for c in stations.columns if c != "S_ID"}
    joined = dimensions.lookup(extract, stations, {"S_ID": "S_ID"}, take)
    coefficients = F.array(*[F.col(f"Flow_Coef_{i}") for i in range(1, basis.k + 1)])
    rows = (joined
            .withColumn("AGG_TOTAL_FLOW", projection.mean_of_reconstruction(coefficients, basis))
            .withColumn("CHP_INC", F.when(F.col("CHP_INC") == "T", 1.0).otherwise(0.0))
            .withColumn("DAY_OF_WEEK", F.weekday(F.to_date("DATE", "MM-dd-yyyy")))
            .drop("DATE", *DROPPED))
    for column in ENCODED:
        if column in rows.columns:
            rows = reshape.one_hot(rows, column, (levels or {}).get(column))
    return rows


def coefficient_summary(coefficients: DataFrame, top: int = 20) -> DataFrame:
    """Weights summed per feature over all runs: size, sign, share of the largest; top n."""
    summed = (coefficients.groupBy("feature").agg(F.sum("weight").alias("_w"))
              .filter(F.col("_w").isNotNull())
              .select("feature", F.abs("_w").alias("size"), (F.col("_w") < 0).alias("negative")))
    largest = summed.agg(F.max("size")).scalar()
    return (summed.withColumn("normalised", F.try_divide(F.col("size"), largest))
            .orderBy(F.desc("normalised"), "feature").limit(top))
