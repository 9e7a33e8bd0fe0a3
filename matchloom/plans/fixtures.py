"""Catalogue, feed and artwork views over the part table, by rules that SQL can state too, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import barcode as B
from matchloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    quantity = (
        F.when(k % 5 == 0, F.concat(size, F.lit("g")))
        .when(k % 5 == 1, F.concat(F.lit("2x"), size, F.lit("g")))
        .when(k % 5 == 2, F.concat(size, F.lit(".5kg")))
        .when(k % 5 == 3, F.concat(size, F.lit("ml")))
        .otherwise(F.concat(size, F.lit(" rolls")))
    )
    rows = table(spark, sf_dir, "part")
    tasks = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a small file is one task, and what follows is all expressions
        rows = rows.repartition(tasks, "p_partkey")
    return rows.select(k.alias("master_id"), B.make_gtin("500", k).alias("gtin"), F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), "p_type").alias("product_name"), quantity.alias("quantity"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intake event for each product: what the supplier typed, what was read off the pack, and the master record."""
    k = F.col("master_id")
    other = B.make_gtin("500", k + 1)
    supplier_gtin = F.when(k % 7 == 3, F.substring("gtin", 1, 12)).when(k % 11 == 5, other).when(k % 13 == 6, F.lit("")).otherwise(F.col("gtin"))
    artwork_gtin = F.when(k % 9 == 4, F.substring("gtin", 2, 12)).when(k % 17 == 8, B.make_gtin("501", k)).when(k % 19 == 9, F.lit("")).otherwise(F.col("gtin"))
    supplier_name = F.when(k % 3 == 1, F.upper("product_name")).when(k % 3 == 2, T.truncate_name("product_name")).otherwise(F.col("product_name"))
    supplier_brand = F.when(k % 8 == 2, F.upper("brand")).when(k % 8 == 5, F.concat("brand", F.lit(" Ltd."))).otherwise(F.col("brand"))
    supplier_quantity = F.when(k % 4 == 1, T.reformat_quantity("quantity")).otherwise(F.col("quantity"))
    artwork_brand = F.when(k % 10 == 7, F.lit("")).otherwise(F.upper("brand"))
    artwork_quantity = F.when(k % 6 == 5, F.lit("")).otherwise(F.upper("quantity"))
    return catalog(spark, sf_dir).select(
        F.concat(F.lit("evt-"), F.lpad(k.cast("string"), 6, "0")).alias("event_id"),
        k.alias("true_master_id"),
        supplier_brand.alias("supplier_brand"),
        supplier_name.alias("supplier_name"),
        supplier_quantity.alias("supplier_quantity"),
        supplier_gtin.alias("supplier_gtin"),
        artwork_brand.alias("artwork_brand"),
        F.when(k % 10 == 7, F.lit("")).otherwise(F.col("product_name")).alias("artwork_name"),
        artwork_quantity.alias("artwork_quantity"),
        artwork_gtin.alias("artwork_gtin"),
        F.col("brand").alias("master_brand"),
        F.col("product_name").alias("master_name"),
        F.col("quantity").alias("master_quantity"),
        F.col("gtin").alias("master_gtin"),
    )


# The same for the SQL engine that checks results.


def sql_check13(body: str) -> str:
    return f"((10 - list_sum(list_transform(range(1, 13), lambda i: cast(substr({body}, i, 1) as int) * case when i % 2 = 1 then 1 else 3 end)) % 10) % 10)"


def sql_make_gtin(prefix: str, number: str) -> str:
    body = f"('{prefix}' || lpad(cast({number} as varchar), 9, '0'))"
    return f"({body} || cast({sql_check13(body)} as int))"


def sql_valid13(code: str) -> str:
    return f"(case when regexp_full_match({code}, '[0-9]{{13}}') then cast(substr({code}, 13, 1) as int) = {sql_check13(code)} else false end)"


def sql_valid_gtin(code: str) -> str:
    total = f"list_sum(list_transform(range(1, length({code})), lambda i: cast(substr({code}, length({code}) - i, 1) as int) * case when i % 2 = 1 then 3 else 1 end))"
    return f"(case when regexp_full_match({code}, '[0-9]{{8}}|[0-9]{{12,14}}') then (10 - {total} % 10) % 10 = cast(substr({code}, length({code}), 1) as int) else false end)"


def sql_gtin14(code: str) -> str:
    return f"(case when regexp_full_match({code}, '[0-9]+') and length({code}) < 14 then lpad({code}, 14, '0') else {code} end)"


def sql_normalize_text(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"


def sql_normalize_quantity(x: str) -> str:
    pack, single = r"^(\d+)\s*[xX]\s*([\d.]+)\s*(kg|g|l|ml)", r"(?i)([\d.]+)\s*(kg|g|l|ml)"
    amount = f"(case when regexp_matches({x}, '{pack}') then cast(regexp_extract({x}, '{pack}', 2) as double) * cast(regexp_extract({x}, '{pack}', 1) as double) else try_cast(regexp_extract({x}, '{single}', 1) as double) end)"
    unit = f"(case when regexp_matches({x}, '{pack}') then regexp_extract({x}, '{pack}', 3) else lower(regexp_extract({x}, '{single}', 2)) end)"
    return f"(case when regexp_matches({x}, '{pack}') or regexp_matches({x}, '{single}') then printf('%g', {amount} * case when {unit} in ('kg', 'l') then 1000 else 1 end) || case when {unit} in ('kg', 'g') then 'g' else 'ml' end else lower(trim({x})) end)"


def sql_tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')), ' ')"


def sql_ratio(x: str, y: str) -> str:
    """Of two texts of sorted tokens, neither empty: twice the longest common subsequence, by its table row by row, over both lengths."""
    cell = f"case when unicode(substr({y}, j[1], 1)) = c[1] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], acc[j[1]]) end"
    row = f"list_reduce(list_transform(range(0, length({y}) + 1), lambda i: [i::bigint]), lambda acc, j: list_append(acc, {cell}))"
    table = f"list_reduce(list_concat([list_transform(range(0, length({y}) + 1), lambda i: 0::bigint)], list_transform(string_split({x}, ''), lambda l: [unicode(l)::bigint])), lambda prev, c: {row})"
    return f"(2 * list_last({table})::double / (length({x}) + length({y})))"


SQL_CATALOG = f"""catalog as (
  select p_partkey as master_id, {sql_make_gtin("500", "p_partkey")} as gtin, p_brand as brand, p_name || ' ' || p_type as product_name,
    case p_partkey % 5 when 0 then p_size || 'g' when 1 then '2x' || p_size || 'g' when 2 then p_size || '.5kg' when 3 then p_size || 'ml' else p_size || ' rolls' end as quantity
  from part)"""

_TRUNCATED = "case when len(string_split_regex(trim(product_name), '\\s+')) > 2 then array_to_string(list_slice(string_split_regex(trim(product_name), '\\s+'), 1, len(string_split_regex(trim(product_name), '\\s+')) - 1), ' ') else product_name end"
_REFORMATTED = """case when quantity like '%g' and not contains(quantity, 'x') then case when try_cast(regexp_extract(quantity, '^(.*)g$', 1) as double) is not null then printf('%.3fkg', try_cast(regexp_extract(quantity, '^(.*)g$', 1) as double) / 1000) else quantity end
    when quantity like '%ml' then case when try_cast(regexp_extract(quantity, '^(.*)ml$', 1) as double) is not null then printf('%.2fL', round(try_cast(regexp_extract(quantity, '^(.*)ml$', 1) as double) / 1000 + 1e-9, 2)) else quantity end else quantity end"""

SQL_EVENTS = f"""{SQL_CATALOG}, events0 as (
  select 'evt-' || lpad(cast(master_id as varchar), 6, '0') as event_id, master_id as true_master_id,
    case when master_id % 8 = 2 then upper(brand) when master_id % 8 = 5 then brand || ' Ltd.' else brand end as supplier_brand,
    case when master_id % 3 = 1 then upper(product_name) when master_id % 3 = 2 then {_TRUNCATED} else product_name end as supplier_name,
    case when master_id % 4 = 1 then {_REFORMATTED} else quantity end as supplier_quantity,
    case when master_id % 7 = 3 then substr(gtin, 1, 12) when master_id % 11 = 5 then {sql_make_gtin("500", "(master_id + 1)")} when master_id % 13 = 6 then '' else gtin end as supplier_gtin,
    case when master_id % 10 = 7 then '' else upper(brand) end as artwork_brand,
    case when master_id % 10 = 7 then '' else product_name end as artwork_name,
    case when master_id % 6 = 5 then '' else upper(quantity) end as artwork_quantity,
    case when master_id % 9 = 4 then substr(gtin, 2, 12) when master_id % 17 = 8 then {sql_make_gtin("501", "master_id")} when master_id % 19 = 9 then '' else gtin end as artwork_gtin,
    brand as master_brand, product_name as master_name, quantity as master_quantity, gtin as master_gtin
  from catalog)"""
