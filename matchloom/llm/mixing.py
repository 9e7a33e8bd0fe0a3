"""Mixing sources to target weights, by blocks.

Each source's documents are laid end to end in a hashed order and cut into blocks of a fixed number of words. Output shards get numbers of blocks of
each source: a multinomial draw given each source's total, so that the totals meet the targets. The k-th slot of a source takes the block at
the k-th place of a pseudorandom permutation of its blocks, again from the start in a second pass, and slots are joined to blocks by
index. All of it is DataFrame expressions; the driver sees a row for each source and no document.

The permutation is a swap-or-not shuffle: in each of its rounds an index and its mirror image under a round key change places or not, as a
hash of the larger one says. It needs no table and permutes any number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, WORD, documents, small_table, written
from matchloom.llm.sharding import communication_matrix

#: Words of a block, rounds of the permutation, output shards, and hashed parts of a source, which bound what one task orders.
BLOCK, ROUNDS, SHARDS, PARTS = 64, 24, 16, 1024
#: Documents of a part, on average, beyond which there are more parts.
PART_ROWS = 1 << 17


def weights_in_turn(k: int) -> float:
    """3, 1, 2, repeating."""
    return (3.0, 1.0, 2.0)[k % 3]


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes by weight; what exceeds `most` times a size goes to the others by weight, until nothing does."""
    total = share * sum(sizes)
    target = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n]
    while free:
        mass = sum(weights[i] for i in free)
        full = [i for i in free if total * weights[i] > most * sizes[i] * mass]
        if not full:
            for i in free:
                target[i] = total * weights[i] / mass
            break
        for i in full:
            target[i] = most * sizes[i]
            total -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """The place of index in a pseudorandom permutation of 0 to n - 1."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when((F.xxhash64(seed, r + F.lit(1000), F.greatest(x, mirror)) % 2) == 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def laid_out(docs: DataFrame) -> DataFrame:
    """docs with `size` (words), `_s` (a key of the source that isn't null) and `_h` (the hash that orders a source)."""
    rows = docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
    return rows.withColumn("_h", F.xxhash64("doc_id", F.lit(7)))


def _offsets(rows: DataFrame) -> DataFrame:
    """Adds `_off`: a sum over parts, then one within the part. No window holds more than one part of one source."""
    per_part = rows.groupBy("_s", "_part").agg(F.sum("size").alias("_n"))
    before = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("_s", "_part").orderBy("_h", "doc_id", "_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(before, ["_s", "_part"]).withColumn("_off", F.col("_before") + F.col("_in")).drop("_before", "_in")


def plan(rows: DataFrame, weight: Callable[[int], float], share: float, most: float, block: int, shards: int, seed: int) -> tuple[list[dict], list[dict]]:
    """A row for each source: size, target, blocks and slots; and for each source and shard the slots it gets: first and number."""
    sizes = {r["_s"]: r["n"] for r in rows.groupBy("_s").agg(F.sum("size").alias("n")).collect()}  # a row a source
    order = sorted(sizes, key=lambda s: (s == "null", s))  # by code point, null last
    targets = water_fill([sizes[s] for s in order], [weight(k) for k in range(len(order))], share, most)
    sources = []
    for k, (s, target) in enumerate(zip(order, targets)):
        blocks = -(-sizes[s] // block)
        slots = min(int(most * blocks), round(target * blocks / sizes[s])) if sizes[s] else 0
        sources.append({"_s": s, "source_size": sizes[s], "target": target, "_blocks": blocks, "_slots": slots, "_seed": seed + k})
    total = sum(x["_slots"] for x in sources)
    columns = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([x["_slots"] for x in sources], columns, seed)
    drawn = []
    for x, counts in zip(sources, matrix):
        first = 0
        for shard, n in enumerate(counts):
            if n:
                drawn.append({"_s": x["_s"], "shard": shard, "first": first, "n": n})
            first += n
    return sources, drawn


SOURCE = "_s string, source_size bigint, target double, _blocks bigint, _slots bigint, _seed bigint"


def slots(spark: SparkSession, sources: list[dict], drawn: list[dict]) -> DataFrame:
    """A row for each slot of the mix: source, shard, slot within the source, block and pass (0 for the first). Spark takes it for as small as the table it is made from, so
    joins with it have to name their way, or they would broadcast it."""
    known = F.broadcast(small_table(spark, sources, SOURCE).filter("_slots > 0"))  # a row a source
    dealt = small_table(spark, drawn, "_s string, shard int, first bigint, n bigint")
    # Long ranges are cut first, so that one source's slots are no single row's doing.
    step = 1 << 14
    ranges = dealt.select("_s", "shard", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))
    # An explicit number: a few ranges of a few bytes would else be read by one task, which then makes all slots.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(d["n"] for d in drawn) // (8 * step)))
    ranges = ranges.repartition(tasks, F.col("_s"), F.col("shard"), F.col("at"))
    each = ranges.select("_s", "shard", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + step, F.col("n")) - 1)).alias("slot"))
    placed = each.join(known, "_s")
    return placed.select("_s", "shard", "slot", permuted(F.pmod("slot", F.col("_blocks")), F.col("_blocks"), F.col("_seed")).alias("block"), F.floor(F.col("slot") / F.col("_blocks")).cast("int").alias("pass"))


def _pieces(laid: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document reaches into: which of the document's words are there."""
    some = laid.filter("size > 0").select("*", F.posexplode(F.sequence(F.floor(F.col("_off") / block), F.floor((F.col("_off") + F.col("size") - 1) / block))).alias("_k", "block"))
    start = F.greatest(F.col("block") * block - F.col("_off"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("_off"), F.col("size"))
    return some.withColumn("_from", start).withColumn("_words", end - start)


def mix(docs: DataFrame, weight: Callable[[int], float] = weights_in_turn, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces): each document with size, source_size, target and taken; each slot of the mix; and the words that each document has in each block.

    A null text has no words. A null source is a source, the last. Rows that repeat are laid out each for itself, and get the same name where they can't be
    told apart. A source without words has target 0. An empty table gives empty results. Other columns are left out."""
    spark = docs.sparkSession
    rows = laid_out(docs.select("doc_id", "source", "text")).withColumn("_t", F.xxhash64("text")).drop("text")
    rows = written(rows, "sizes")
    rows = rows.withColumn("_part", F.pmod("_h", F.lit(max(PARTS, rows.count() // PART_ROWS))).cast("int"))
    sources, drawn = plan(rows, weight, share, most, block, shards, seed)
    laid = _offsets(rows)
    each = slots(spark, sources, drawn)
    pieces = _pieces(laid.select("doc_id", "_s", "_t", "size", "_off"), block).select("doc_id", "_s", "_t", "size", "_off", "block", "_from", "_words")
    times = each.groupBy("_s", "block").agg(F.count("*").alias("_times"))
    taken = pieces.join(times.hint("merge"), ["_s", "block"]).groupBy("_s", "_off").agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    known = F.broadcast(small_table(spark, sources, SOURCE).select("_s", "source_size", "target"))
    return _with_taken(laid, taken).join(known, "_s").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), each, pieces


def _with_taken(laid: DataFrame, taken: DataFrame) -> DataFrame:
    """By place in the source, which no two documents with words share; those without words have taken none."""
    some = laid.filter("size > 0").join(taken.hint("merge"), ["_s", "_off"], "left")
    return some.unionByName(laid.filter("size = 0"), allowMissingColumns=True)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: for each document and pass that takes words of it, a row of docs' columns whose `text` is what is taken, in its own order.

    A text that is taken whole stays as it is; of others, whole words with the white space behind them stay. n_chars, where there is one, is the length of the new
    text. Rows that repeat doc_id and text are laid out as often as they stand, and give one row a pass with the words of all and the other columns of the first by their JSON. Documents of which nothing is taken, as
    empty ones, are left out. No Python takes part. An empty table gives an empty result."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
    _, each, pieces = mix(docs, **how)
    some = pieces.join(each.select("_s", "block", "pass").hint("merge"), ["_s", "block"])
    lists = some.groupBy(key("doc_id").alias("_id"), "_t", "pass").agg(F.sort_array(F.collect_set(F.struct("_from", "_words"))).alias("cuts"))  # a document's own blocks
    rest = F.to_json(F.struct(*(F.col(f"doc.`{c}`") for c in docs.columns if c not in ("doc_id", "text")))) if set(docs.columns) - {"doc_id", "text"} else F.lit("")
    joined = keyed.join(lists.hint("merge"), ["_id", "_t"]).withColumn("_n", F.row_number().over(W.partitionBy("_id", "_t", "pass").orderBy(rest))).filter("_n = 1")
    text = F.col("doc.text").cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD + SPACE + "*"), F.lit(0))
    taken = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["_words"].cast("long"))
    cut = F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(words, (c["_from"] + 1).cast("int"), c["_words"].cast("int")))), "")
    made = joined.select("doc", F.when(taken >= F.regexp_count(text, F.lit(WORD)), text).otherwise(cut).alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return made.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[0].drop("source")
