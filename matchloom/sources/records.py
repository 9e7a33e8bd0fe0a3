"""Readers and writers of catalogues, feeds, gold pairs, product records and calibrators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions import barcode as B
from matchloom.functions import text as T
from matchloom.operators import calibration

CATALOG = "master_id long, gtin string, brand string, product_name string, quantity string, category string, image_url string"
FEED = "true_master_id long, submitted_brand string, submitted_product_name string, submitted_quantity string, submitted_gtin string, corruption_applied string"
#: Runs that have a folder of their own, and datasets of the last.
MODES, DATASETS = ("synthetic", "real", "leipzig"), ("abt-buy", "amazon-google")


def run_dir(root: str, mode: str, dataset: str | None = None) -> str:
    """A folder for each kind of run, so that none reads another's tables."""
    if mode not in MODES or (mode == "leipzig" and dataset not in DATASETS):
        raise ValueError(f"unknown run: {mode} {dataset or ''}".strip())
    return f"{root}/{mode}/{dataset}" if mode == "leipzig" else f"{root}/{mode}"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A headed CSV. Without a schema all columns are text: codes lose their zeros otherwise."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(path).select("master_id", "gtin", "brand", "product_name", "quantity")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows: int = 100_000) -> DataFrame:
    """A table of a database file that all executors can open, `rows` row ids a task."""
    import sqlite3

    with sqlite3.connect(path) as db:
        low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
    columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def read(frames):
        import pandas as pd

        for frame in frames:
            for start in frame["id"]:
                with sqlite3.connect(path) as db:
                    yield pd.read_sql_query(f'select {", ".join(columns)} from "{table}" where rowid >= ? and rowid < ?', db, params=(int(start), int(start) + rows))

    starts = spark.range(low, high + 1, rows)
    return starts.repartition(max(1, -(-(high + 1 - low) // rows))).mapInPandas(read, schema)


def in_file_order(df: DataFrame) -> DataFrame:
    """df with `pos`, which rises in the order of the file for files that one task reads."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def last_wins(pairs: DataFrame, key: str) -> DataFrame:
    """The last row of each key by `pos`."""
    return pairs.groupBy(key).agg(F.max_by(F.struct(*(c for c in pairs.columns if c not in (key, "pos"))), "pos").alias("_r")).select(key, "_r.*")


def first_wins(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The first row of each key by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*rows.columns)


def benchmark_records(raw: DataFrame) -> DataFrame:
    """(rec_id, name, manufacturer) of either side: the name stands in a column called name or title."""
    has = set(raw.columns)
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("name", "title") if c in has]
    return raw.select(F.col("id").cast("string").alias("rec_id"), F.coalesce(*named, F.lit("Unknown")).alias("name"), T.blank("manufacturer").alias("manufacturer") if "manufacturer" in has else F.lit("").alias("manufacturer"))


#: Rows of a range that are ranked together, on average, and the most ranges.
RANGE_ROWS, RANGES = 50_000, 1024


def _range_of(x: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are x or less, by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(x < F.lit(bounds[half]), _range_of(x, bounds[:half], first)).otherwise(_range_of(x, bounds[half + 1 :], first + half + 1))


def benchmark_catalog(records: DataFrame, order: str, prefix: str) -> DataFrame:
    """A catalogue of numbered records with made codes. Numbers are ranks over ranges of the order, so no task ranks all.

    A range exchange draws its bounds anew each time it runs, so they are taken once, one a range, and are literals from there on: counts and ranks are then of the same ranges."""
    ranges = min(RANGES, -(-records.count() // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        least = records.select(order).repartitionByRange(ranges, order).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(order).alias("least"))
        bounds = sorted({r["least"] for r in least.filter("least is not null").collect()})[1:]
    key = F.col(order)
    ranged = records.withColumn("_p", F.when(key.isNull(), F.lit(0)).otherwise(_range_of(key, bounds)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order))).join(F.broadcast(counts), "_p")
    number = F.col("_before") + F.col("_r")
    return numbered.select(number.alias("master_id"), "rec_id", B.make_gtin(prefix, number).alias("gtin"), F.col("manufacturer").alias("brand"), F.col("name").alias("product_name"), F.lit("").alias("quantity"))


def benchmark_events(mapping: DataFrame, records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Intake events of gold pairs (supplier_id, catalog_id): no codes and no pack. Pairs whose ends are missing are dropped."""
    bare = lambda c: T.strip(F.regexp_replace(F.lower(T.blank(c)), r"(?U)\s+", " "))
    s = records.select(F.col("rec_id").alias("supplier_id"), F.col("manufacturer").alias("supplier_brand"), F.col("name").alias("supplier_name"))
    m = catalog.select(F.col("rec_id").alias("catalog_id"), F.col("master_id").alias("true_master_id"), F.col("brand").alias("master_brand"), F.col("product_name").alias("master_name"))
    empty = {c: F.lit("") for c in ("supplier_quantity", "supplier_gtin", "artwork_brand", "artwork_name", "artwork_quantity", "artwork_gtin", "master_quantity", "master_gtin")}
    joined = mapping.join(s, "supplier_id").join(m, "catalog_id")
    return joined.select(F.concat(F.lit("evt-"), "supplier_id").alias("event_id"), "true_master_id", "supplier_brand", "supplier_name", bare("supplier_brand").alias("supplier_norm_brand"), bare("supplier_name").alias("supplier_norm_name"), "master_brand", "master_name", *(v.alias(k) for k, v in empty.items()))


#: A product record as the public product API gives it; only these fields are parsed.
PRODUCT = "code string, brands string, product_name string, quantity string, categories string, image_front_url string, selected_images map<string,struct<display:map<string,string>,small:map<string,string>,thumb:map<string,string>>>"


def best_image_urls(images: Column) -> Column:
    """For each view the stored URL of the largest size in its first language, at full resolution; views without one are left out."""
    first = lambda urls: F.get(F.map_values(urls), F.lit(0))
    url = lambda v: F.regexp_replace(F.coalesce(first(v["display"]), first(v["small"]), first(v["thumb"])), r"\.(100|200|400)\.jpg$", ".full.jpg")
    return F.map_filter(F.transform_values(images, lambda _, v: url(v)), lambda _, u: u.isNotNull())


def product_records(raw: DataFrame, column: str = "json", order: str = "pos") -> DataFrame:
    """Records of JSON texts: those without a code or name are dropped, the first of each code stays, and the code's status is told."""
    p = raw.select(order, F.from_json(column, PRODUCT).alias("p")).select(order, "p.*")
    named = p.filter((T.strip(T.blank("code")) != "") & (T.strip(T.blank("product_name")) != ""))
    urls = best_image_urls(F.coalesce("selected_images", F.from_json(F.lit("{}"), "map<string,struct<display:map<string,string>,small:map<string,string>,thumb:map<string,string>>>")))
    rows = named.select("code", order, T.strip(F.get(F.split(T.blank("brands"), ","), F.lit(0))).alias("brand"), T.strip("product_name").alias("product_name"), T.blank("quantity").alias("quantity"), T.blank("categories").alias("category"), urls.alias("image_urls"), F.col("image_front_url").alias("image_url"))
    rows = rows.withColumn("has_packaging_view", F.map_contains_key("image_urls", "packaging")).withColumn("barcode_status", B.barcode_status("code"))
    return rows.groupBy("code").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("code", order))), order).alias("r")).select("code", "r.*")


def catalog_from_products(products: DataFrame) -> DataFrame:
    """Catalogue columns; a product without a brand is told so."""
    return products.select(F.col("code").alias("gtin"), F.when(F.col("brand") == "", F.lit("(no brand)")).otherwise(F.col("brand")).alias("brand"), "product_name", "quantity", "category", "image_url")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as binary rows; what reads them is given as a function on Arrow batches (mapInArrow)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).select("path", "length", "content")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_calibrator(spark: SparkSession, calibrator, path: str, meta: dict | None = None) -> None:
    """One small text file, through Spark's file systems."""
    spark.range(1).select(F.lit(calibration.to_json(calibrator, meta)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_calibrator(spark: SparkSession, path: str):
    """The stored calibrator, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return calibration.from_json(spark.read.text(path, wholetext=True).first()["value"])
    except AnalysisException:
        return None


def duplicate_codes(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("gtin").agg(F.count("*").alias("n")).filter("n > 1")
