"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into source blocks by a hash. The numbers of rows that each block sends to each shard are drawn from the
multivariate hypergeometric law, which is that of a uniform permutation. Each block permutes its rows and cuts them by its row of
the matrix, rows are exchanged, and each shard permutes what it got. All of it is DataFrame expressions; the driver draws a
matrix of blocks x shards and sees no row.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import documents, small_table


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good. Inversion outward from the mode, so that it also serves beyond 10^9 rows."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - top
    up, p_up, down, p_down = mode, top, mode, top
    while u > 0 and (up < high or down > low) and p_up + p_down > 1e-18:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these margins, as a uniform permutation of all rows would have them."""
    assert sum(rows) == sum(columns)
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        rest, counts = sum(left), []
        for j, m in enumerate(left):
            take = hypergeometric(rng, m, rest - m, n) if j + 1 < len(left) else n
            counts.append(take)
            rest, n = rest - m, n - take
        left = [m - k for m, k in zip(left, counts)]
        out.append(counts)
    return out


#: Rows of a block on average, beyond which there are more blocks than the least number.
BLOCK_ROWS, BLOCKS = 1 << 20, 256


def shuffle_into_shards(rows: DataFrame, key: Column, n_shards: int, blocks: int | None = None, seed: int = 20) -> DataFrame:
    """rows with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in its shard); shards differ by one row at most.

    key makes the random order, so rows of equal keys (repeats of one row) stand next to each other in an order of no matter; null keys
    count as one key. `blocks` bounds what one task sorts: a shard is permuted in blocks too; by default it follows the number of rows. Blocks are classes of
    the key's hash, not input partitions, so that a rerun over other splits deals alike. Columns called shard or slot are replaced. An empty table gives an empty result."""
    blocks = blocks or max(BLOCKS, rows.count() // BLOCK_ROWS)
    rows = rows.drop("shard", "slot")
    mixed = rows.withColumn("_k1", F.xxhash64(key, F.lit(seed))).withColumn("_k2", F.xxhash64(key, F.lit(seed + 1)))
    mixed = mixed.withColumn("_block", F.pmod(F.shiftrightunsigned("_k1", 20), F.lit(blocks)).cast("int"))
    counts = dict(mixed.groupBy("_block").agg(F.count("*").alias("n")).collect())  # at most `blocks` rows
    present = sorted(counts)
    total = sum(counts.values())
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts[b] for b in present], sizes, seed)
    ends = []
    for b, row in zip(present, matrix):
        at, cuts = 0, []
        for n in row:
            at += n
            cuts.append(at)
        ends.append({"_block": b, "_ends": cuts})
    table = F.broadcast(small_table(rows.sparkSession, ends, "_block int, _ends array<bigint>"))
    permuted = mixed.withColumn("_r", F.row_number().over(W.partitionBy("_block").orderBy("_k1", "_k2")) - 1)
    sent = permuted.join(table, "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int"))
    sent = sent.withColumn("_sub", F.pmod(F.shiftrightunsigned("_k2", 20), F.lit(blocks)).cast("int"))
    per_sub = sent.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = per_sub.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    slotted = sent.withColumn("_q", F.row_number().over(W.partitionBy("shard", "_sub").orderBy("_k2", "_k1")) - 1).join(F.broadcast(before), ["shard", "_sub"])  # shards x blocks rows
    return slotted.withColumn("slot", (F.col("_before") + F.col("_q")).cast("long")).drop("_k1", "_k2", "_block", "_ends", "_r", "_sub", "_q", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 24, blocks: int | None = None, seed: int = 20) -> DataFrame:
    """Each document's size, checksum, shard and slot. Only these columns are exchanged, never the text.

    A null text has no bytes and the checksum of the empty text. A null doc_id is a key like any other; other columns are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(8)).otherwise(F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shuffle_into_shards(rows, F.struct("doc_id", "text_crc32"), n_shards, blocks, seed).withColumn("law", F.lit("rows"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes documents by shard, each shard's rows in slot order. A row finds its place by doc_id and checksum of its text, rows that repeat both by their rank, so every row
    takes one slot of its own. Columns called shard or slot are replaced by these."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")))
    places = assigned.select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32").alias("_key"), "shard", "slot")
    ranked = lambda df, *by: df.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*by)))
    rows = ranked(docs.drop("shard", "slot").withColumn("_key", key), "text")
    joined = rows.join(ranked(places, "shard", "slot"), ["_key", "_n"]).drop("_key", "_n")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
