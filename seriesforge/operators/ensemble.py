"""Votes of several models, their learned weights, and insights from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .series import KEY

#: Weights of the models. Fixed values.
WEIGHTS = {"fourier": 0.35, "hmm": 0.35, "dtw": 0.30}


def fourier_vote(forecast: DataFrame, confidence: DataFrame) -> DataFrame:
    """The mean of the forecast's second half less that of its first; confidence: entity, confidence."""
    f = forecast.groupBy(KEY).agg((F.avg(F.when(F.col("step") > 15, F.col("forecast"))) - F.avg(F.when(F.col("step") <= 15, F.col("forecast")))).alias("prediction"))
    return f.join(confidence, KEY).select(KEY, F.lit("fourier").alias("model"), "prediction", "confidence")


def hmm_vote(current: DataFrame, profiles: DataFrame) -> DataFrame:
    """Thirty days of the present regime's mean return."""
    j = current.join(profiles.select(KEY, "state", "mean_return"), [KEY, "state"])
    return j.select(KEY, F.lit("hmm").alias("model"), (F.col("mean_return") * 30).alias("prediction"), F.col("probability").alias("confidence"))


def dtw_vote(predictions: DataFrame, least: float = 0.5) -> DataFrame:
    return predictions.where(F.col("confidence") >= least).select(KEY, F.lit("dtw").alias("model"), F.col("predicted").alias("prediction"), "confidence")


def agreement(p: Column) -> Column:
    """1 for one vote, 0.3 for mixed signs, else 1 / (1 + deviation / mean size)."""
    mixed = (F.max(p) > 0) & (F.min(p) < 0)
    return F.when(F.count(p) < 2, 1.0).when(mixed, 0.3).otherwise(F.coalesce(1 / (1 + F.stddev_pop(p) / F.nullif(F.abs(F.avg(p)), F.lit(0.0))), F.lit(1.0)))


def vote(predictions: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row for each entity: value and confidence weighted over its models, whose weights are normalised, and their agreement. predictions: entity, model, prediction, confidence."""
    if weights is None:
        pairs = [F.struct(F.lit(k).alias("model"), F.lit(v).alias("weight")) for k, v in WEIGHTS.items()]
        w = F.element_at(F.filter(F.array(*pairs), lambda s: s["model"] == F.col("model")), 1)["weight"]
        df = predictions.withColumn("weight", w)
    else:
        df = predictions.join(weights, "model", "left")
    df = df.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    wc = F.col("weight") * F.col("confidence")
    value = F.sum(wc * F.col("prediction")) / F.nullif(F.sum(wc), F.lit(0.0))
    return df.groupBy(KEY).agg(F.count("*").alias("models"), F.coalesce(value, F.lit(0.0)).alias("value"), F.coalesce(F.sum(wc) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("confidence"), agreement(F.col("prediction")).alias("agreement"))


def recent(series: DataFrame) -> DataFrame:
    """Means of the last 7 rows, of the 23 before, and of all; null where the series is shorter."""
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("idx")))
    v = F.col("value")
    a = series.withColumn("_b", back).groupBy(KEY).agg(F.count("*").alias("_n"), F.avg(F.when(F.col("_b") <= 7, v)).alias("_l"), F.avg(F.when(F.col("_b").between(8, 30), v)).alias("_h"), F.avg("value").alias("usual"))
    return a.select(KEY, F.when(F.col("_n") >= 7, F.col("_l")).alias("last7"), F.when((F.col("_n") >= 30) & (F.col("_h") > 0), F.col("_l") / F.col("_h")).alias("ratio"), "usual")


def classify(votes: DataFrame, series: DataFrame, durations: DataFrame, match: DataFrame) -> DataFrame:
    """The vote with its type, anomaly score and insights. durations: entity, expected_duration; match: entity, match_confidence."""
    j = votes.join(recent(series), KEY, "left").join(durations, KEY, "left").join(match, KEY, "left")
    kind = R.prediction_type(F.col("value"), F.col("expected_duration"), F.col("last7"), F.col("usual"))
    score = R.anomaly_score(F.col("agreement"), F.col("match_confidence"), F.col("ratio"))
    text = F.array_compact(
        F.array(
            F.when(F.col("agreement") > 0.8, F.lit("Models agree")).when(F.col("agreement") < 0.5, F.lit("Models disagree")),
            F.when(F.col("value") > 2, F.lit("Activity is expected to rise")).when(F.col("value") < -2, F.lit("Activity is expected to fall")),
            F.when(F.col("expected_duration") < 7, F.lit("The present regime is short-lived")),
            F.when(F.col("match_confidence") < 0.6, F.lit("The recent pattern has few precedents")),
            F.when(F.col("ratio") > 3, F.lit("Recent activity is far above the usual")),
        )
    )
    return j.select(KEY, "models", "value", "confidence", "agreement", kind.alias("type"), score.alias("anomaly"), F.slice(text, 1, 5).alias("insights"))


def meta_weights(history: DataFrame, keep: int = 100) -> DataFrame:
    """Weights by 1 / (1 + mean error times confidence) over each model's last `keep` rows (model, seq, predicted, actual, confidence); models without history count an error of 1, and with none at all the fixed weights hold."""
    w = Window.partitionBy("model").orderBy(F.desc("seq"))
    h = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    e = h.groupBy("model").agg(F.avg(F.abs(F.col("predicted") - F.col("actual")) * F.col("confidence")).alias("e"))
    known = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.lit(v).alias("fixed")) for k, v in WEIGHTS.items())))
    base = history.sparkSession.range(1).select(known.alias("k")).select("k.model", "k.fixed")
    j = base.join(e, "model", "left").withColumn("raw", 1 / (1 + F.coalesce("e", F.lit(1.0))))
    whole = Window.partitionBy()  # three rows
    any_ = F.count("e").over(whole) > 0
    return j.select("model", F.when(any_, F.col("raw") / F.sum("raw").over(whole)).otherwise(F.col("fixed")).alias("weight"))


SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def _insight(df: DataFrame, when: Column, kind: str, severity: Column | str, title: Column | str, confidence: Column, evidence: dict[str, Column], advice: str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    pairs = [y for k, v in evidence.items() for y in (F.lit(k), v.cast("string"))]
    return df.where(when).select(KEY, F.lit(kind).alias("type"), lit(severity).alias("severity"), lit(title).alias("title"), confidence.cast("double").alias("confidence"), F.create_map(*pairs).alias("evidence"), F.array(F.lit(advice)).alias("recommendations"))


def insights(cycles: DataFrame, profiles: DataFrame, current: DataFrame, matches: DataFrame, ensemble: DataFrame, least: float = 0.7, pairs: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
    """One projection for each rule, joined, kept from this confidence on, with a priority by severity, then confidence.

    pairs: a, b, r, p, lag; each entity hears of its three strongest. shares: entity, sector, share.
    """
    c = F.col("confidence")
    best = cycles.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("strength"), "frequency"))).where("_r = 1")
    many = cycles.groupBy(KEY).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    now = current.join(profiles, [KEY, "state"]).withColumn("confidence", F.col("probability"))
    found = matches.groupBy(KEY).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max("similarity").alias("similarity"))
    rules = [
        _insight(best, c >= 0.0, "cycle", F.when(c > 0.85, "high").otherwise("medium"), F.concat(F.lit("Dominant cycle: "), F.col("category")), c, {"period_days": F.round("period_days", 3)}, "Compare the next weeks with the cycle's phase"),
        _insight(best, F.col("category") == "election_cycle", "cycle", "high", "Election cycle", c, {"period_days": F.round("period_days", 3)}, "Compare with the calendar of elections"),
        _insight(many, F.col("n") >= 3, "cycle", "medium", "Several cycles overlap", c, {"cycles": F.col("n")}, "Look at the decomposition"),
        _insight(now, F.lit(True), "regime", F.when(F.col("regime") == "High Volatility", "high").otherwise("info"), F.concat(F.lit("Present regime: "), F.col("regime")), c, {"probability": F.round("probability", 6)}, "Weigh risk by regime"),
        _insight(now, F.col("expected_duration") < 7, "regime", "high", "Regime change is near", c, {"expected_duration": F.round("expected_duration", 6)}, "Watch for a change within the week"),
        _insight(now, F.col("volatility") > 0.03, "regime", "medium", "Rough regime", c, {"volatility": F.round("volatility", 6)}, "Expect wide swings"),
        _insight(found, F.col("similarity") > 0.85, "precedent", "high", "A strong precedent", c, {"similarity": F.round("similarity", 6)}, "Look at what followed"),
        _insight(found, F.col("n") >= 5, "precedent", "medium", "Several precedents", c, {"matches": F.col("n")}, "Look at what followed"),
        _insight(ensemble, F.col("anomaly") > 0.7, "anomaly", "critical", "Unusual activity", F.col("anomaly"), {"anomaly": F.round("anomaly", 6)}, "Review the last weeks"),
        _insight(ensemble, F.col("agreement") < 0.5, "ensemble", "medium", "Models disagree", 1 - F.col("agreement"), {"agreement": F.round("agreement", 6)}, "Treat the forecast with care"),
        _insight(ensemble, F.abs("value") > 10, "prediction", "high", F.when(F.col("value") > 0, "A large increase is predicted").otherwise("A large decrease is predicted"), c, {"predicted_change": F.round("value", 6)}, "Compare what happens with the forecast"),
        _insight(ensemble, c > 0.8, "ensemble", "high", "A confident forecast", c, {"value": F.round("value", 6)}, "Plan for it"),
    ]
    if pairs is not None:
        strong = pairs.where((F.abs("r") > 0.7) & (F.col("p") < 0.05))
        sides = strong.select(F.col("a").alias(KEY), F.col("b").alias("other"), "r", "p", "lag").unionByName(strong.select(F.col("b").alias(KEY), F.col("a").alias("other"), "r", "p", (-F.col("lag")).alias("lag")))
        near = sides.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.abs("r").desc(), "other"))).where("_r <= 3")
        rules.append(_insight(near, F.lit(True), "correlation", F.when(F.abs("r") > 0.8, "high").otherwise("medium"), F.concat(F.lit("Moves with "), F.col("other").cast("string")), 1 - F.col("p"), {"correlation": F.round("r", 6), "p_value": F.round("p", 6), "lag": F.col("lag")}, "Look at what the two share"))
    if shares is not None:
        first = shares.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("share"), "sector"))).where("_r = 1")
        rules.append(_insight(first, F.col("share") > 0.7, "sector", "medium", F.concat(F.lit("Concentrated in "), F.col("sector")), F.lit(0.85), {"share": F.round("share", 6)}, "Weigh specialisation against spread"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity"))
    w = Window.partitionBy(KEY).orderBy(rank, F.desc("confidence"), "title")
    return out.where(c >= least).withColumn("priority", F.row_number().over(w))


def summary(insights_: DataFrame) -> DataFrame:
    """Counts by severity, status and the three first titles of each entity."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("priority") <= 3, F.struct("priority", "title")))), 1, 3), lambda x: x["title"])
    return insights_.groupBy(KEY).agg(F.count("*").alias("total"), n("critical").alias("critical"), n("high").alias("high"), top.alias("top")).withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 2, "high").otherwise("normal"))
