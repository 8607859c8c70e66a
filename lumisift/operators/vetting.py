"""Tables of review decisions: (candidate_id, vetter_id, vetting_round, classification, confidence, decided_at, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import true
from .windows import keep_first

#: The classes and confidences a decision may have, and the classes that call for another round.
CLASSIFICATIONS = ["planet", "eb_missed", "instrumental", "background", "known_variable", "unexplained_uninteresting", "unexplained_interesting", "megastructure_candidate", "unsure"]
CONFIDENCES = ["low", "medium", "high"]
REVET = ["unsure", "unexplained_interesting", "megastructure_candidate"]


def validate_decisions(decisions: DataFrame, classes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with a reason)."""
    known = true(F.col("classification").isin(classes or CLASSIFICATIONS))
    reason = F.when(F.col("candidate_id").isNull(), "candidate_id is missing").when(~known, "unknown classification").when(~true(F.col("confidence").isin(CONFIDENCES)), "unknown confidence")
    checked = decisions.withColumn("reason", reason)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def record_decisions(decisions: DataFrame, path: str, classes: list[str] | None = None) -> DataFrame:
    """Append the valid decisions to a log; returns the rejects."""
    valid, rejects = validate_decisions(decisions, classes)
    valid.write.mode("append").parquet(path)
    return rejects


def decisions_for(log: DataFrame, candidate_id: object) -> DataFrame:
    """A candidate's decisions of all vetters and rounds, in order."""
    return log.filter(F.col("candidate_id") == F.lit(candidate_id)).orderBy("vetting_round", "decided_at", "vetter_id")


def latest(log: DataFrame, keys: tuple[str, ...] = ("candidate_id", "vetter_id")) -> DataFrame:
    """The last decision per key."""
    newest = [F.desc_nulls_last("vetting_round"), F.desc_nulls_last("decided_at"), F.asc("classification")]
    return keep_first(log, list(keys), newest)


def paired(log: DataFrame) -> DataFrame:
    """(candidate_id, vetter_a, vetter_b, class_a, class_b): last decisions of two vetters on one candidate, a < b."""
    last = latest(log).select("candidate_id", "vetter_id", "classification")
    a = last.select("candidate_id", F.col("vetter_id").alias("vetter_a"), F.col("classification").alias("class_a"))
    b = last.select("candidate_id", F.col("vetter_id").alias("vetter_b"), F.col("classification").alias("class_b"))
    return a.join(b, "candidate_id").filter("vetter_a < vetter_b")


def agreement(log: DataFrame, target: float = 0.8) -> DataFrame:
    """(vetter_a, vetter_b, n, agreed, share, reaches_target): candidates that two vetters classify alike."""
    share = F.col("agreed") / F.col("n")
    return paired(log).groupBy("vetter_a", "vetter_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_a") == F.col("class_b")).alias("agreed")).withColumns({"share": share, "reaches_target": share > target})


def confusion(log: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Counts by class of the first vetter (rows) and of the second (columns)."""
    return paired(log).groupBy("class_a").pivot("class_b", classes or CLASSIFICATIONS).count().na.fill(0)


def revet_queue(log: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(candidate_id, classification, rounds, unsure_rounds, action): last decisions that call for another look; twice unsure escalates."""
    unsure = F.countDistinct(F.when(F.col("classification") == "unsure", F.col("vetting_round")))
    rounds = log.groupBy("candidate_id").agg(F.countDistinct("vetting_round").alias("rounds"), unsure.alias("unsure_rounds"))
    last = latest(log, ("candidate_id",)).filter(F.col("classification").isin(classes or REVET)).select("candidate_id", "classification")
    return last.join(rounds, "candidate_id").withColumn("action", F.when((F.col("classification") == "unsure") & (F.col("unsure_rounds") >= 2), "escalate").otherwise("revet"))
