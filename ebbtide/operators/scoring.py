"""Churn scores: fitting at an earlier cutoff, scoring at a later one, judging the ranking."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ebbtide.functions import day, ratio
from ebbtide.operators.drivers import band, numeric_features
from ebbtide.operators.preparation import between
from ebbtide.plans import durable, prefix_sum, quantiles
from ebbtide.sources import literal_rows

CATEGORIES = ("segment", "region")


def with_label(customers: DataFrame, label: DataFrame) -> DataFrame:
    """`customers` that have a label, plus `churned`.

    Both have a row per customer, so they are sorted and merged: a broadcast would bring the
    label of every customer to the driver.
    """
    return customers.join(label.hint("merge"), "k")


def fit_churn_model(
    features: DataFrame,
    label: DataFrame,
    numeric: Sequence[str] | None = None,
    categories: Sequence[str] = CATEGORIES,
    reg: float = 0.01,
) -> PipelineModel:
    """Logistic regression of `churned` with penalty `reg`; missing numbers take the mean, unseen categories their own.

    The joined input is kept for the passes of the fit only and can be recomputed if an
    executor is lost.
    """
    numeric = list(numeric or numeric_features())
    index = [f"{c}_index" for c in categories]
    code = [f"{c}_code" for c in categories]
    filled = [f"{c}_filled" for c in numeric]
    coded = [
        StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=code),
    ]
    stages = (coded if categories else []) + [
        Imputer(inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled + code, outputCol="inputs"),
        LogisticRegression(featuresCol="inputs", labelCol="churned", regParam=reg, maxIter=100, tol=1e-9),
    ]
    wanted = with_label(features, label).select(
        "churned", *categories, *[F.col(c).cast("double").alias(c) for c in numeric]
    )
    wanted = wanted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(wanted)
    finally:
        wanted.unpersist()


def save_model(model: PipelineModel, folder: str) -> None:
    """Write a model where later sessions can load it from; the folder must be new."""
    model.write().save(folder)


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """k, risk: the model's churn probability for every row of `features`, which needs the
    columns the model was fitted to."""
    indexers = [s for s in model.stages if s.hasParam("stringOrderType")]
    categories = indexers[0].getInputCols() if indexers else []
    numeric = next(s for s in model.stages if s.hasParam("missingValue")).getInputCols()
    ready = features.select("k", *categories, *[F.col(c).cast("double").alias(c) for c in numeric])
    return model.transform(ready).select("k", vector_to_array("probability")[1].alias("risk"))


def _parts(model: PipelineModel) -> tuple[list[str], list[str], list[list[str]], list[float], list[float], float]:
    """Numeric columns, categories, their values, coefficients in order, means, intercept."""
    indexers = [s for s in model.stages if s.hasParam("stringOrderType")]
    imputer = next(s for s in model.stages if s.hasParam("missingValue"))
    numeric = imputer.getInputCols()
    means = imputer.surrogateDF.select(*numeric).first()
    fitted = model.stages[-1]
    return (
        numeric,
        indexers[0].getInputCols() if indexers else [],
        [list(x) for x in indexers[0].labelsArray] if indexers else [],
        [float(c) for c in fitted.coefficients],
        [float(m) for m in means],
        float(fitted.intercept),
    )


def model_terms(model: PipelineModel) -> DataFrame:
    """term, coefficient, fill: the model as a table. The intercept is the term ``, a number the
    name of its column, with what stands in for a missing one, and a category `column=value`.
    Values of a category that the fit has not seen have no term and add nothing."""
    numeric, categories, values, coefficients, means, intercept = _parts(model)
    names = numeric + [f"{c}={v}" for c, own in zip(categories, values) for v in own]
    fills = means + [None] * (len(names) - len(means))
    rows = [("", intercept, None), *zip(names, coefficients, fills, strict=True)]
    return literal_rows(SparkSession.active(), rows, "term string, coefficient double, fill double")


def score_by_terms(terms: DataFrame, features: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """k, risk: `score`'s risk from a table of terms, by a join and a sum.

    A customer becomes a row per column and meets the terms on their names, so the table can be
    edited, compared or moved to another engine as it is. There are few terms and the planner
    knows how many, so customers do not move for the join.
    """
    pairs = [F.struct(F.lit("").alias("term"), F.lit(1.0).alias("value"))]
    pairs += [F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value")) for c in numeric]
    pairs += [F.struct(F.concat(F.lit(f"{c}="), c).alias("term"), F.lit(1.0).alias("value")) for c in categories]
    missing = F.col("value").isNull() | F.isnan("value")
    added = F.col("coefficient") * F.when(missing, F.col("fill")).otherwise(F.col("value"))
    summed = (
        features.select("k", F.inline(F.array(*pairs)))
        .join(terms, "term")
        .groupBy("k")
        .agg(F.sum(added).alias("s"))
    )
    return summed.select("k", (1 / (1 + F.exp(-F.col("s")))).alias("risk"))


def model_gradient(model: PipelineModel, features: DataFrame, label: DataFrame) -> DataFrame:
    """term, coefficient, gradient: the slope of what the fit minimises, per term, at the model.

    That is the mean log loss plus half of `regParam` times the squared coefficients, both for
    inputs scaled to a standard deviation of one; at the optimum every slope is 0. The sums are
    one aggregate over the rows, and a row per term is left. A term whose input does not vary
    has none (0).
    """
    numeric, categories, values, _, _, _ = _parts(model)
    terms = [""] + numeric + [f"{c}={v}" for c, own in zip(categories, values) for v in own]
    ready = with_label(features, label).select(
        "churned", *categories, *[F.col(c).cast("double").alias(c) for c in numeric]
    )
    off = vector_to_array("probability")[1] - F.col("churned")
    inputs = F.concat(F.array(F.lit(1.0)), vector_to_array("inputs"))
    sums = (
        model.transform(ready)
        .select(off.alias("off"), F.posexplode(inputs).alias("at", "x"))
        .groupBy("at")
        .agg(F.avg(F.col("off") * F.col("x")).alias("slope"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("spread"))
    )
    rows = [(i, name) for i, name in enumerate(terms)]
    named = literal_rows(features.sparkSession, rows, "at int, term string").join(model_terms(model), "term")
    reg = float(model.stages[-1].getRegParam())
    scaled = F.col("slope") / F.nullif("spread", F.lit(0.0)) + reg * F.col("coefficient") * F.col("spread")
    slope = F.when(F.col("term") == "", F.col("slope")).otherwise(F.coalesce(scaled, F.lit(0.0)))
    return sums.join(named, "at").select("term", "coefficient", slope.alias("gradient"))


def recency_score(facts: DataFrame, cutoff: str | dt.date, lookback_days: int = 365) -> DataFrame:
    """k, risk: days since the last order as a share of the lookback; a score without a model."""
    at = day(cutoff)
    since = F.datediff(F.lit(at), F.max("d"))
    return (
        between(facts, at - dt.timedelta(lookback_days), at)
        .groupBy("k")
        .agg((since / lookback_days).alias("risk"))
    )


def lift_table(scores: DataFrame, label: DataFrame, bins: int = 10, exact: bool = True) -> DataFrame:
    """Per risk band, `bins` highest: customers, churned, rate, capture.

    capture is the share of all leavers found in this band and the riskier ones. The running
    window sees one row per band. The scores are written once, as both the cutpoints and the
    counts read them.
    """
    scores = durable(scores.select("k", "risk"))
    judged = with_label(scores, label)
    cuts = quantiles(scores, ["risk"], [i / bins for i in range(1, bins)], exact)["risk"]
    riskier = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    return (
        judged.groupBy(band(F.col("risk"), cuts).alias("band"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("churned").alias("churned"))
        .withColumn("rate", ratio(F.col("churned"), F.col("customers")))
        .withColumn("capture", ratio(F.sum("churned").over(riskier), F.sum("churned").over(whole)))
    )


def auc(scores: DataFrame, label: DataFrame) -> DataFrame:
    """customers, churned, auc: chance that a leaver outranks a stayer, ties counting half.

    Exact. Stayers below each distinct score come from a prefix sum over range partitions.
    """
    per_score = (
        with_label(scores, label)
        .groupBy("risk")
        .agg(F.sum("churned").alias("gone"), F.sum(1 - F.col("churned")).alias("kept"))
    )
    ranked = prefix_sum(per_score, [F.col("risk")], F.col("kept"), "upto")
    below = F.col("upto") - F.col("kept") / 2
    totals = ranked.agg(
        F.sum("gone").alias("churned"),
        F.sum("kept").alias("kept"),
        F.sum(F.col("gone") * below).alias("wins"),
    )
    return totals.select(
        (F.col("churned") + F.col("kept")).alias("customers"),
        "churned",
        ratio(F.col("wins"), F.col("churned").cast("double") * F.col("kept")).alias("auc"),
    )


def value_scores(
    scores: DataFrame, facts: DataFrame, cutoff: str | dt.date, days: int = 365
) -> DataFrame:
    """k, risk, value, at_risk: spend in the `days` before the cutoff, and risk times it."""
    at = day(cutoff)
    spend = (
        between(facts, at - dt.timedelta(days), at).groupBy("k").agg(F.sum("amount").alias("value"))
    )
    value = F.coalesce("value", F.lit(0.0))
    return scores.join(spend, "k", "left").select(
        "k", "risk", value.alias("value"), (F.col("risk") * value).alias("at_risk")
    )


def value_at_risk(valued: DataFrame, dims: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by` columns, customers, value, at_risk: sums of `value_scores` per dimension."""
    return (
        valued.join(dims.select("k", *by), "k", "left")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("value").alias("value"),
            F.sum("at_risk").alias("at_risk"),
        )
    )
