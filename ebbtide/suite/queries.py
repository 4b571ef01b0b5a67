"""One query per operator over the input tables, with the parameters the SQL checks use."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators import churn, drivers, events, preparation, response, scoring
from ebbtide.plans import shared_folder
from ebbtide.session import apply_settings
from ebbtide.sources import SCHEMAS, literal_rows, load, write_result
from ebbtide.streaming import activity

CUTOFF = dt.date(2000, 8, 1)
TRAIN_CUTOFF = dt.date(1999, 8, 1)
SNAPSHOT = dt.date(2001, 8, 1)  # last day with orders
LAST_QUARTER_DAY = dt.date(2001, 6, 30)  # end of the last whole quarter
LAST_EVENT_DAY = dt.date(2024, 1, 30)
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
DIMS = ("region", "segment")
STEPS = ("view", "click", "purchase")
SALT, HOLDOUT_PCT = "spring", 20
BUDGET = 5000.0
STEEPEST = 1e-6  # slope per standard deviation at which a term counts as fitted
BURST = "2024-01-10 08:00:00"
_SAVED: dict[tuple[str, str], str] = {}

SEGMENT_RULES = [
    ("champion", 1, 4, 5, 4, 5, 4, 5),
    ("big spender slipping", 2, 1, 2, 1, 5, 4, 5),
    ("loyal", 3, 3, 5, 4, 5, 1, 5),
    ("lapsing", 4, 1, 2, 1, 5, 1, 5),
    ("recent", 5, 4, 5, 1, 3, 1, 5),
]
ACTION_RULES = [
    (1, 0.5, None, 400000.0, None, "call", 25.0),
    (2, 0.5, None, None, 400000.0, "letter", 2.0),
    (3, 0.25, 0.5, 200000.0, None, "coupon", 5.0),
    (4, None, 0.1, 600000.0, None, "thank", 1.0),
]


class Inputs:
    """The tables of one folder and the frames most queries start from, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = apply_settings(spark), sf_dir
        self.read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.read:
            self.read[name] = load(self.spark, self.sf_dir, name)
        return self.read[name]

    def facts(self) -> DataFrame:
        return preparation.order_facts(self["orders"])

    def days(self) -> DataFrame:
        return preparation.order_days(self["orders"])

    def dims(self) -> DataFrame:
        return preparation.customer_dims(self["customer"], self["nation"], self["region"])

    def gaps(self) -> DataFrame:
        return churn.purchase_gaps(self.days())

    def customers(self) -> DataFrame:
        return self["customer"].select(F.col("c_custkey").alias("k"))

    def label(self, cutoff: dt.date = CUTOFF) -> DataFrame:
        return churn.churn_label(self.facts(), cutoff, observed_until=SNAPSHOT)

    def features(self, cutoff: dt.date = CUTOFF) -> DataFrame:
        return drivers.features(self["orders"], self.dims(), cutoff)

    def risk(self) -> DataFrame:
        return scoring.recency_score(self.facts(), CUTOFF)

    def valued(self) -> DataFrame:
        return scoring.value_scores(self.risk(), self.facts(), CUTOFF)

    def assigned(self) -> DataFrame:
        rules = literal_rows(self.spark, ACTION_RULES, response.RULE_COLUMNS)
        return response.assign_action(self.valued(), rules)

    def model(self) -> PipelineModel:
        """Fitted once per session and folder, then loaded from where it was saved."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _SAVED:
            folder = shared_folder(self.spark, "churn-model")
            features, label = self.features(TRAIN_CUTOFF), self.label(TRAIN_CUTOFF)
            scoring.save_model(scoring.fit_churn_model(features, label), folder)
            _SAVED[key] = folder
        return scoring.load_model(_SAVED[key])

    def model_scores(self) -> DataFrame:
        return scoring.score(self.model(), self.features())

    def hot_events(self) -> DataFrame:
        """The events with a third of them on one user, many at equal times and many in a burst."""
        at = F.col("ts")
        start = F.lit(BURST).cast("timestamp_ntz")
        return self["events"].select(
            "event_id",
            F.when(F.col("event_id") % 7 == 0, F.date_trunc("day", at).cast("timestamp_ntz"))
            .when(F.col("event_id") % 5 == 0, start + F.make_dt_interval(secs=F.col("event_id") % 600))
            .otherwise(at)
            .alias("ts"),
            F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"),
            "event_type",
            "value",
            "props",
        )

    def stream(self) -> DataFrame:
        # A pattern, because the table may be one file or a folder of files.
        return activity.read_events(self.spark, f"{self.sf_dir}/event[s].parquet")


def comparable(df: DataFrame, cents: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Types and rounding two engines agree on: dates and times as text, whole numbers as
    bigint, `cents` columns to two digits and other fractions to `digits`."""

    def plain(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 2 if f.name in cents else digits) + F.lit(0.0)
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


def _load(x: Inputs) -> DataFrame:
    counts = [
        x[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in SCHEMAS
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def _written(x: Inputs) -> DataFrame:
    folder = shared_folder(x.spark, "order-days")
    write_result(x.days().withColumn("year", F.year("d")), folder, partition_by=["year"])
    return x.spark.read.parquet(folder)


def _nation_rules(x: Inputs) -> DataFrame:
    """A rule per nation around its mean risk and value, some of which overlap."""
    means = (
        x.valued()
        .join(x["customer"], F.col("k") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("rule_id"))
        .agg(F.round(F.avg("risk"), 4).alias("r"), F.round(F.avg("value"), 2).alias("v"))
    )
    return means.select(
        "rule_id",
        (F.col("r") - 0.01).alias("risk_lo"),
        (F.col("r") + 0.01).alias("risk_hi"),
        (F.col("v") * 0.98).alias("value_lo"),
        (F.col("v") * 1.02).alias("value_hi"),
    )


def _calibration(x: Inputs) -> DataFrame:
    """customers, churned, mean_risk of the rows the model was fitted to. The constant is not
    penalised, so at the optimum the mean risk is the share that churned."""
    judged = scoring.with_label(scoring.score(x.model(), x.features(TRAIN_CUTOFF)), x.label(TRAIN_CUTOFF))
    return judged.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("churned").alias("churned"),
        F.round(F.avg("risk"), 3).alias("mean_risk"),
    )


def _scored(x: Inputs) -> DataFrame:
    """k and whether the risk is a probability; the risk itself no SQL can know."""
    return x.model_scores().select("k", F.col("risk").between(0, 1).alias("valid"))


def _auc_model(x: Inputs) -> DataFrame:
    """The model's counts, and whether its AUC is what Spark's own evaluator finds."""
    scores = x.model_scores()
    judged = scoring.with_label(scores, x.label()).withColumn("churned", F.col("churned").cast("double"))
    other = BinaryClassificationEvaluator(rawPredictionCol="risk", labelCol="churned", numBins=0)
    same = F.abs(F.col("auc") - F.lit(other.evaluate(judged))) < 1e-9
    return scoring.auc(scores, x.label()).select("customers", "churned", same.alias("agrees"))


def _terms(x: Inputs) -> DataFrame:
    """The model's terms, coefficients and slopes, and whether each slope is as good as 0."""
    found = scoring.model_gradient(x.model(), x.features(TRAIN_CUTOFF), x.label(TRAIN_CUTOFF))
    return found.withColumn("settled", F.abs("gradient") < STEEPEST)


def _risks(x: Inputs) -> DataFrame:
    """k, the model's risk and the same from the table of its terms, merged on the customer."""
    model = x.model()
    own = scoring.score_by_terms(
        scoring.model_terms(model), x.features(), drivers.numeric_features(), scoring.CATEGORIES
    )
    own = own.withColumnRenamed("risk", "risk_by_terms").hint("merge")
    return scoring.score(model, x.features()).join(own, "k")


def _sketched(x: Inputs) -> DataFrame:
    """Quantiles of the gaps from one stored sketch per order day."""
    folder = shared_folder(x.spark, "gap-sketches")
    write_result(churn.gap_sketches(x.gaps()).withColumn("year", F.year("d")), folder, "replace", ["year"])
    return churn.sketched_quantiles(x.spark.read.parquet(folder), PROBS)


def _approximate(x: Inputs) -> DataFrame:
    """prob, and whether the approximate quantile is off by at most a ten-thousandth in rank."""
    gaps = x.gaps()
    cuts = {r["prob"]: r["gap"] for r in churn.gap_quantiles(gaps, PROBS, exact=False).collect()}
    total = F.count(F.lit(1))
    return gaps.agg(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("prob"),
                    (
                        (F.lit(p) >= F.count_if(F.col("gap") < F.lit(cut)) / total - 1e-4)
                        & (F.lit(p) <= F.count_if(F.col("gap") <= F.lit(cut)) / total + 1e-4)
                    ).alias("close"),
                )
                for p, cut in cuts.items()
            ]
        ).alias("found")
    ).select(F.inline("found"))


def _segmented(x: Inputs) -> DataFrame:
    rules = literal_rows(x.spark, SEGMENT_RULES, drivers.RULE_COLUMNS)
    return drivers.rfm_segment(drivers.rfm(x.facts(), SNAPSHOT), rules)


def _survival_by_segment(x: Inputs) -> DataFrame:
    spells = churn.spells(x.days(), SNAPSHOT).join(x.dims().select("k", "segment"), "k")
    return churn.survival_curve(spells, ["segment"])


def _replayed(x: Inputs) -> DataFrame:
    once = activity.stream_dedup(x.stream().union(x.stream()))
    return once.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
                       "event_type", "value", "props")


def _enriched(x: Inputs) -> DataFrame:
    return activity.stream_enrich(activity.stream_idle_alerts(x.stream()), x.dims())


def _stream(build: Callable[[Inputs], DataFrame], name: str) -> Callable[[Inputs], DataFrame]:
    return lambda x: activity.run_to_end(build(x), name)


_MONEY = ("amount", "value", "at_risk", "total", "last_value", "priority", "balance",
          "spend_90", "spend_180", "spend_365")
_COARSE = {"spend_trend": 4, "driver_contrast": 4}

_BUILD: dict[str, Callable[[Inputs], DataFrame]] = {
    # Sources and preparation
    "load": _load,
    "order_days": lambda x: x.days(),
    "integrity_report": lambda x: preparation.integrity_report({n: x[n] for n in SCHEMAS}),
    "period_spine": lambda x: preparation.period_spine(x.facts(), LAST_QUARTER_DAY),
    "write_result": _written,
    # Churn definition and measurement
    "purchase_gaps": lambda x: churn.purchase_gaps(x.days()),
    "gap_quantiles": lambda x: churn.gap_quantiles(churn.purchase_gaps(x.days()), PROBS),
    "gap_quantiles_approx": _approximate,
    "gap_quantiles_sketched": _sketched,
    "recency_state": lambda x: churn.recency_state(x.facts(), CUTOFF, 180),
    "churn_label": lambda x: x.label(),
    "churn_rate": lambda x: churn.churn_rate(x.label(), x.dims(), DIMS),
    "churn_rate_rollup": lambda x: churn.churn_rate(
        x.label(), x.dims(), ("region", "nation", "segment"), "rollup"
    ),
    "churn_rate_cube": lambda x: churn.churn_rate(x.label(), x.dims(), DIMS, "cube"),
    "period_status": lambda x: churn.period_status(x.facts(), LAST_QUARTER_DAY),
    "growth_accounting": lambda x: churn.growth_accounting(
        churn.period_status(x.facts(), LAST_QUARTER_DAY)
    ),
    "cohort_retention": lambda x: churn.cohort_retention(x.facts(), LAST_QUARTER_DAY),
    "spells": lambda x: churn.spells(x.days(), SNAPSHOT),
    "survival_curve": lambda x: churn.survival_curve(churn.spells(x.days(), SNAPSHOT)),
    "survival_curve_by_segment": _survival_by_segment,
    "last_orders": lambda x: churn.last_orders(x.days(), 3),
    # Segmentation and drivers
    "rfm": lambda x: drivers.rfm(x.facts(), SNAPSHOT),
    "rfm_segment": _segmented,
    "features": lambda x: x.features(),
    "return_share": lambda x: drivers.return_share(x["lineitem"], x["orders"], CUTOFF),
    "spend_trend": lambda x: drivers.spend_trend(x.facts(), CUTOFF),
    "driver_contrast": lambda x: drivers.driver_contrast(
        x.features(), x.label(), drivers.numeric_features()
    ),
    "category_lift": lambda x: drivers.category_lift(
        x.label(), x.dims(), ("segment", "region", "nation")
    ),
    "feature_correlation": lambda x: drivers.feature_correlation(
        x.features(), drivers.numeric_features()
    ),
    # Scoring
    "fit_churn_model": _calibration,
    "fit_churn_model_terms": _terms,
    "score": _scored,
    "score_risk": _risks,
    "lift_table": lambda x: scoring.lift_table(x.risk(), x.label()),
    "auc": lambda x: scoring.auc(x.risk(), x.label()),
    "auc_model": _auc_model,
    "auc_model_value": lambda x: scoring.auc(x.model_scores(), x.label()),
    "value_scores": lambda x: x.valued(),
    "value_at_risk": lambda x: scoring.value_at_risk(x.valued(), x.dims(), DIMS),
    # Response strategy
    "assign_action": lambda x: x.assigned(),
    "check_rules": lambda x: response.check_rules(_nation_rules(x)),
    "top_targets": lambda x: response.top_targets(x.valued(), x.dims(), "region", 20),
    "budget_list": lambda x: response.budget_list(x.assigned(), BUDGET),
    "holdout": lambda x: response.holdout(x.customers(), SALT, HOLDOUT_PCT),
    "experiment_readout": lambda x: response.experiment_readout(
        response.holdout(x.customers(), SALT, HOLDOUT_PCT), x.label()
    ),
    # Event behaviour and streaming
    "sessions": lambda x: events.sessions(x["events"]),
    "funnel": lambda x: events.funnel(x["events"], STEPS),
    "event_retention": lambda x: events.event_retention(
        x["events"], (1, 3, 7, 14, 28), LAST_EVENT_DAY
    ),
    "quiet_periods": lambda x: events.quiet_periods(x["events"]),
    "rolling_errors": lambda x: events.rolling_errors(x["events"]),
    "last_before": lambda x: events.last_before(x["events"], "purchase"),
    "funnel_hot": lambda x: events.funnel(x.hot_events(), STEPS),
    "rolling_errors_hot": lambda x: events.rolling_errors(x.hot_events()),
    "last_before_hot": lambda x: events.last_before(x.hot_events(), "purchase"),
    "stream_activity": _stream(lambda x: activity.stream_activity(x.stream()), "activity"),
    "stream_activity_sliding": _stream(
        lambda x: activity.stream_activity(x.stream(), "2 days", "1 day"), "sliding"
    ),
    "stream_sessions": _stream(lambda x: activity.stream_sessions(x.stream()), "sessions"),
    "stream_dedup": _stream(_replayed, "dedup"),
    "stream_idle_alerts": _stream(lambda x: activity.stream_idle_alerts(x.stream()), "alerts"),
    "stream_enrich": _stream(_enriched, "enriched"),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(_BUILD[name](Inputs(spark, sf_dir)), _MONEY, _COARSE.get(name, 6))

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in _BUILD}
