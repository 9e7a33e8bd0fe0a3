"""The whole decision on each intake event: agreement, ranked candidates, barcodes, aliases, route and problem class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import agreement as A
from matchloom.operators import routing as R
from matchloom.operators import state as S


def decide(events: DataFrame, ranked: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, calibrator=None, key: str = "event_id", joined: bool = False) -> DataFrame:
    """A decision row for each event that has a candidate. ranked: query_id (the event's `key`), top_id, top_score and runner_up_score.

    The barcode check takes the winner's own code, whatever the event's master record says. An event without candidates has no decision; an empty table gives an empty result.
    joined: events of one event_id are told apart by nothing else, so each cross-check and ranking meets each barcode check and each master record of that id, as when tables of
    them are joined by it."""
    codes = catalog.select(F.col("master_id").alias("top_id"), F.col("gtin").alias("winner_gtin"))
    rows = events.join(ranked.withColumnRenamed("query_id", key), key).join(codes, "top_id")
    rows = S.with_alias_hits(rows, aliases, "supplier_brand", "supplier_name") if aliases is not None else rows.withColumn("alias_hit", F.lit(False))
    rows = rows.withColumn("second", A.second_source(events)).withColumn("barcode", A.verify_three_way("artwork_gtin", "supplier_gtin", "winner_gtin"))
    rows = A.cross_check(rows, ("top_id", "top_score", "runner_up_score", "alias_hit", "second", "barcode")).withColumn("agreement", A.source_agreement())
    if joined:
        checks, master = ("agreement", "second", "top_score", "runner_up_score", "alias_hit"), ("true_master_id", "top_id")
        shared = rows.groupBy("event_id").agg(F.collect_list(F.struct(*checks, "barcode", *master)).alias("_same"))  # the events of one id
        shared = shared.withColumn("_check", F.explode("_same")).withColumn("_code", F.explode("_same")).withColumn("_master", F.explode("_same"))
        rows = shared.select("event_id", *(f"_check.{c}" for c in checks), "_code.barcode", *(f"_master.{c}" for c in master))
    rows = rows.withColumn("decision", R.route(F.col("agreement"), F.col("top_score"), F.col("runner_up_score"), F.col("barcode"), F.col("second"), F.col("alias_hit"), calibrator=calibrator))
    return rows.select(
        "event_id",
        "true_master_id",
        F.col("top_id").alias("resolved_id"),
        (F.col("top_id") == F.col("true_master_id")).alias("correct"),
        R.problem_class(F.col("agreement"), F.col("decision.route"), F.col("second")).alias("problem_class"),
        "alias_hit",
        "decision.route",
        "decision.confidence",
        "decision.sig_source_agreement",
        "decision.sig_text_match",
        "decision.sig_barcode",
        F.array_join("decision.overrides", "|").alias("overrides"),
        "decision.rationale",
        F.col("barcode.verdict").alias("barcode_verdict"),
        F.col("barcode.score").alias("barcode_score"),
        F.array_join("barcode.agreeing", "|").alias("barcode_agreeing"),
        F.array_join("barcode.corrupt_sources", "|").alias("barcode_corrupt_sources"),
        F.col("barcode.detail").alias("barcode_detail"),
    )


def replay_alias(held: DataFrame, names: DataFrame, approver: str, at) -> DataFrame:
    """Approvals of held decisions that were right: alias_key, resolved_id, resolved_name, approved_by and approved_at, to be merged into the alias table for a second pass."""
    from matchloom.functions.text import alias_key

    right = held.filter((F.col("route") == "hold_for_review") & F.col("correct"))
    return right.join(names, "event_id").select(alias_key("supplier_brand", "supplier_name").alias("alias_key"), "resolved_id", F.col("master_name").alias("resolved_name"), F.lit(approver).alias("approved_by"), at.alias("approved_at"))


def trace(decisions: DataFrame, event_id: str) -> DataFrame:
    return decisions.filter(F.col("event_id") == event_id)


def inspect(picked: DataFrame, gold: DataFrame, names: DataFrame, errors_only: bool = False) -> DataFrame:
    """Picks beside a gold record's name, the first in id order, and the picked one's; a dash where there is no gold."""
    first = gold.join(names, gold["right_id"] == names["id"]).groupBy("left_id").agg(F.min_by("name", "id").alias("gold_name"))
    pairs = gold.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("cand_id"), F.lit(True).alias("hit")).distinct()
    out = picked.join(first.withColumnRenamed("left_id", "query_id"), "query_id", "left").join(names.select(F.col("id").alias("cand_id"), F.col("name").alias("picked_name")), "cand_id", "left").join(pairs, ["query_id", "cand_id"], "left")
    out = out.withColumn("correct", F.coalesce("hit", F.lit(False))).withColumn("gold_name", F.coalesce("gold_name", F.lit("—"))).drop("hit")
    return out.filter(~F.col("correct")) if errors_only else out
