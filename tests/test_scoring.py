from __future__ import annotations

import datetime as dt
import math

import pytest
from conftest import TESTDATA, as_set
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ebbtide.operators import drivers, scoring
from ebbtide.sources import SCHEMAS
from ebbtide.suite.queries import QUERIES, STEEPEST, TRAIN_CUTOFF, Inputs


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, str(TESTDATA / "sf0.01"))


@pytest.fixture(scope="module")
def model(inputs):
    return scoring.fit_churn_model(inputs.features(TRAIN_CUTOFF), inputs.label(TRAIN_CUTOFF))


def test_one_probability_per_customer(inputs, model):
    scores = scoring.score(model, inputs.features())
    row = scores.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k"),
        F.min("risk").alias("lo"), F.max("risk").alias("hi"),
    ).first()
    assert row.n == row.k == inputs.features().count()
    assert 0 <= row.lo <= row.hi <= 1


def test_auc_agrees_with_spark_ml(inputs, model):
    scores = scoring.score(model, inputs.features())
    (ours,) = scoring.auc(scores, inputs.label()).collect()
    judged = scores.join(inputs.label(), "k").withColumn("churned", F.col("churned").cast("double"))
    theirs = BinaryClassificationEvaluator(
        rawPredictionCol="risk", labelCol="churned", numBins=0
    ).evaluate(judged)
    assert math.isclose(ours.auc, theirs, abs_tol=1e-9)


def test_fit_drops_its_cache(spark, inputs):
    def kept():
        return set(spark.sparkContext._jsc.getPersistentRDDs())

    before = kept()
    scoring.fit_churn_model(inputs.features(TRAIN_CUTOFF), inputs.label(TRAIN_CUTOFF))
    assert kept() <= before


def _judged(spark, pairs):
    scores = spark.createDataFrame([(i, float(s)) for i, (s, _) in enumerate(pairs)], "k bigint, risk double")
    label = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(pairs)], "k bigint, churned int")
    return scores, label


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(0.9, 1), (0.1, 0)], 1.0),
        ([(0.1, 1), (0.9, 0)], 0.0),
        ([(0.5, 1), (0.5, 0), (0.5, 0)], 0.5),
        ([(0.5, 1), (0.7, 1)], None),
        ([(0.2, 0), (0.4, 1), (0.4, 0), (0.8, 1)], 3.5 / 4),
    ],
)
def test_auc_counts_ties_half(spark, pairs, want):
    (row,) = scoring.auc(*_judged(spark, pairs)).collect()
    assert row.auc == want


def test_lift_table_captures_everybody_in_the_end(spark):
    scores, label = _judged(spark, [(i / 40, int(i % 4 == 0)) for i in range(40)])
    rows = {r.band: r for r in scoring.lift_table(scores, label, 4).collect()}
    assert set(rows) == {1, 2, 3, 4} and sum(r.customers for r in rows.values()) == 40
    assert rows[1].capture == 1.0 and rows[4].capture == 3 / 10 or rows[4].churned == 2


def test_lift_table_of_one_score(spark):
    scores, label = _judged(spark, [(0.5, 1), (0.5, 0)])
    assert as_set(scoring.lift_table(scores, label, 10), "band", "customers", "rate", "capture") == {
        (1, 2, 0.5, 1.0)
    }


def test_value_is_zero_without_orders(spark, facts):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k bigint, risk double")
    got = scoring.value_scores(scores, facts((1, "2000-07-31", 10), (1, "2000-08-01", 99)), "2000-08-01")
    assert as_set(got) == {(1, 0.5, 10.0, 5.0), (2, 0.5, 0.0, 0.0)}
    dims = spark.createDataFrame([(1, "a"), (2, "a")], "k bigint, g string")
    assert as_set(scoring.value_at_risk(got, dims, ["g"])) == {("a", 2, 10.0, 5.0)}


@pytest.mark.parametrize("categories", [("nation",), ()])
def test_a_saved_model_scores_with_its_own_categories(spark, inputs, tmp_path, categories):
    features = inputs.features(TRAIN_CUTOFF).join(inputs.dims().select("k", "nation"), "k")
    label = inputs.label(TRAIN_CUTOFF)
    numeric = ["days_since", "balance"]
    model = scoring.fit_churn_model(features, label, numeric, categories)
    folder = str(tmp_path / "model")
    scoring.save_model(model, folder)
    fresh, loaded = scoring.score(model, features), scoring.score(scoring.load_model(folder), features)
    assert as_set(fresh.limit(50)) <= as_set(loaded)
    assert fresh.filter("risk < 0 or risk > 1").count() == 0


def plain_gradient(inputs, model):
    """Per term, from the rows of the training set in plain Python."""
    import numpy as np

    numeric = list(drivers.numeric_features())
    rows = inputs.features(TRAIN_CUTOFF).join(inputs.label(TRAIN_CUTOFF), "k").collect()
    risk = {r["k"]: r["risk"] for r in scoring.score(model, inputs.features(TRAIN_CUTOFF)).collect()}
    off = np.array([risk[r["k"]] - r["churned"] for r in rows])
    out = {"": off.mean()}
    terms = {r["term"]: r["coefficient"] for r in scoring.model_terms(model).collect()}
    columns = {}
    for c in numeric:
        own = np.array([np.nan if r[c] is None else float(r[c]) for r in rows])
        columns[c] = np.where(np.isnan(own), np.nanmean(own), own)
    for c in scoring.CATEGORIES:
        for v in {r[c] for r in rows}:
            columns[f"{c}={v}"] = np.array([float(r[c] == v) for r in rows])
    for name, own in columns.items():
        spread = own.std(ddof=1)
        out[name] = (off * own).mean() / spread + 0.01 * terms[name] * spread
    return out


def test_gradient_per_term(inputs, model):
    got = scoring.model_gradient(model, inputs.features(TRAIN_CUTOFF), inputs.label(TRAIN_CUTOFF)).collect()
    want = plain_gradient(inputs, model)
    assert {r["term"] for r in got} == set(want) == {r["term"] for r in scoring.model_terms(model).collect()}
    for r in got:
        assert math.isclose(r["gradient"], want[r["term"]], abs_tol=1e-9)
        assert abs(r["gradient"]) < STEEPEST


def test_a_constant_model_is_told_apart(spark, inputs):
    """A model that gives everybody the share that churned has the right mean risk, but slopes."""
    features, label = inputs.features(TRAIN_CUTOFF), inputs.label(TRAIN_CUTOFF)
    constant = scoring.fit_churn_model(features, label, reg=1e9)
    slopes = {r["term"]: r["gradient"] for r in scoring.model_gradient(constant, features, label).collect()}
    assert abs(slopes[""]) < STEEPEST
    # Of what the fit minimises without the penalty that made the model constant.
    terms = {r["term"]: r["coefficient"] for r in scoring.model_terms(constant).collect()}
    assert max(abs(c) for t, c in terms.items() if t) < 1e-9
    risks = {round(r["risk"], 9) for r in scoring.score(constant, features).collect()}
    assert len(risks) == 1
    lenient = constant.copy()
    lenient.stages[-1].set(lenient.stages[-1].regParam, 0.01)
    steep = [abs(r["gradient"]) for r in scoring.model_gradient(lenient, features, label).collect()]
    assert max(steep) > 1000 * STEEPEST


def test_risk_from_the_table_of_terms(spark, inputs, model):
    numeric = list(drivers.numeric_features())
    features = inputs.features().withColumn("days_since", F.when(F.col("k") % 3 > 0, F.col("days_since")))
    features = features.withColumn("region", F.when(F.col("k") % 5 == 0, "nowhere").when(F.col("k") % 7 > 0, F.col("region")))
    own = scoring.score_by_terms(scoring.model_terms(model), features, numeric, scoring.CATEGORIES)
    both = scoring.score(model, features).join(own.withColumnRenamed("risk", "own"), "k")
    rows = both.collect()
    assert len(rows) == features.count() > 0
    assert all(math.isclose(r["risk"], r["own"], abs_tol=1e-9) for r in rows)
    assert len({round(r["risk"], 6) for r in rows}) > len(rows) / 2


def test_auc_of_the_model_by_brute_force(spark):
    folder = str(TESTDATA / "sf0.001")
    (got,) = QUERIES["auc_model_value"](spark, folder).collect()
    small = Inputs(spark, folder)
    pairs = small.model_scores().join(small.label(), "k").collect()
    gone, kept = ([r["risk"] for r in pairs if r["churned"] == c] for c in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in gone for b in kept)
    assert math.isclose(got["auc"], wins / (len(gone) * len(kept)), abs_tol=1e-6)
    assert (got["customers"], got["churned"]) == (len(pairs), len(gone))


def test_registered_results_are_the_models_own(spark):
    folder = str(TESTDATA / "sf0.001")
    risks = QUERIES["score_risk"](spark, folder).collect()
    assert len(risks) == Inputs(spark, folder).features().count()
    assert all(math.isclose(r["risk"], r["risk_by_terms"], abs_tol=2e-6) for r in risks)
    terms = QUERIES["fit_churn_model_terms"](spark, folder).collect()
    assert all(r["settled"] for r in terms) and len({r["term"] for r in terms}) == len(terms) > 20


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A folder of 60 customers who order twice before the first cutoff, and two in three of them
    twice before the second."""
    folder = tmp_path_factory.mktemp("shop")
    days = [dt.datetime(y, 7, d) for y in (1999, 2000) for d in (1, 11)]
    rows = {
        "region": [(0, "north")],
        "nation": [(i, f"n{i}", 0) for i in range(3)],
        "customer": [(k, f"c{k}", k % 3, float(k), f"s{k % 2}") for k in range(60)],
        "orders": [
            (4 * k + i, k, "O", 10.0 + k, at - dt.timedelta(k % 20), "5-LOW")
            for k in range(60) for i, at in enumerate(days) if i < 2 or k % 3 > 0
        ],
    }
    for name, own in rows.items():
        spark.createDataFrame(own, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ran(df):
    """The rows, and the plan as it was in the end, after joins were chosen by measured sizes."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_no_table_of_customers_is_broadcast_for_the_risks(spark, shop):
    rows, plan = ran(QUERIES["score_risk"](spark, shop))
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin [k" not in plan
    assert plan.count("SortMergeJoin [k") == 3 and "BroadcastHashJoin [term" in plan
    assert len(rows) == 40 and all(math.isclose(r["risk"], r["risk_by_terms"], abs_tol=2e-6) for r in rows)


def test_no_table_of_customers_is_broadcast_for_the_fit(spark, shop):
    small = Inputs(spark, shop)
    rows, plan = ran(scoring.with_label(small.features(TRAIN_CUTOFF), small.label(TRAIN_CUTOFF)))
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin [k" not in plan
    assert plan.count("SortMergeJoin [k") == 2
    assert {r["k"]: r["churned"] for r in rows} == {k: int(k % 3 == 0) for k in range(60)}
