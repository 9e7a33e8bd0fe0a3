"""The decision log and the alias table, as versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T


def decision_rows(decisions: DataFrame, evidence: list[str], at: Column | None = None) -> DataFrame:
    """Rows of the log, with the evidence columns as JSON by name."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return decisions.select(stamp.alias("ts"), "event_id", "resolved_id", "true_master_id", "route", "confidence", "problem_class", F.lit("pipeline").alias("decision_maker"), F.lit(None).cast("string").alias("approved_by"), F.to_json(F.struct(*sorted(evidence))).alias("evidence"))


def log_decisions(rows: DataFrame, path: str, keep: bool = True) -> None:
    rows.write.mode("append" if keep else "overwrite").parquet(path)


def with_alias_hits(events: DataFrame, aliases: DataFrame, brand: str, name: str) -> DataFrame:
    """events with alias_key, alias_hit and the id that the alias names, which the route doesn't look at."""
    known = aliases.select("alias_key", F.col("resolved_id").alias("alias_resolved_id"))
    return events.withColumn("alias_key", T.alias_key(brand, name)).join(known, "alias_key", "left").withColumn("alias_hit", F.col("alias_resolved_id").isNotNull())


def approve(aliases: DataFrame, approvals: DataFrame) -> DataFrame:
    """The next version of the alias table: the latest approval of each key replaces its entry, and the count of its uses stays. Approvals without an approver are an error.

    approvals: alias_key, resolved_id, resolved_name, approved_by, approved_at."""
    checked = approvals.withColumn("approved_by", F.when(T.strip(T.blank("approved_by")) == "", F.raise_error(F.lit("an approval needs an approver")).cast("string")).otherwise(F.col("approved_by")))
    latest = checked.groupBy("alias_key").agg(F.max_by(F.struct("resolved_id", "resolved_name", "approved_by", "approved_at"), F.struct("approved_at", "resolved_id")).alias("new"))
    old = aliases.select("alias_key", F.struct("resolved_id", "resolved_name", "approved_by", "approved_at").alias("old"), "times_reused")
    merged = old.join(latest, "alias_key", "full_outer").withColumn("now", F.coalesce("new", "old"))
    return merged.select("alias_key", "now.*", F.coalesce("times_reused", F.lit(0)).cast("long").alias("times_reused"))


def record_reuse(aliases: DataFrame, hits: DataFrame) -> DataFrame:
    """The next version with one more use for each hit (alias_key)."""
    counted = hits.groupBy("alias_key").agg(F.count("*").alias("_n"))
    return aliases.join(counted, "alias_key", "left").withColumn("times_reused", F.col("times_reused") + F.coalesce("_n", F.lit(0))).drop("_n")


def summary(log: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counts by route, by problem class, and of aliases and their uses: (what, name, n)."""
    by = lambda c: log.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), F.col(c).alias("name"), "n")
    totals = aliases.agg(F.count("*").alias("entries"), F.coalesce(F.sum("times_reused"), F.lit(0)).alias("uses"))
    return by("route").unionByName(by("problem_class")).unionByName(totals.select(F.lit("alias").alias("what"), F.inline(F.array(F.struct(F.lit("entries").alias("name"), F.col("entries").alias("n")), F.struct(F.lit("uses").alias("name"), F.col("uses").alias("n"))))))
