"""Queries that write the engine's file formats from the test tables and read them back, with DuckDB SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import encode
from ..operators.stored import new_folder
from ..sources import excel, readers, writers
from .catalog import _BLOBS, _CODE, _LISTS, _MAIN_WIDE, MAIN_BY_TYPE, SUB_BY_BRAND, _blobs, _masks, _order_lists, query, read


@query("SELECT o_orderstatus AS sheet, o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment, o_orderpriority AS \"Priority & more\", o_totalprice > 100000 AS large FROM orders")
def workbook_round_trip(spark, sf):
    """Orders in workbooks with a sheet for each status, typed columns read back."""
    excel.register(spark)
    path = new_folder(spark, "workbook")
    o = read(spark, sf, "orders")
    rows = o.select(F.col("o_orderstatus").alias("sheet"), "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").cast("timestamp_ntz").alias("moment"), F.col("o_orderpriority").alias("Priority & more"), (F.col("o_totalprice") > 100000).alias("large"))
    # Dealt by order, so that no status makes one task's file; each file has its rows sheet by sheet.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").sortWithinPartitions("sheet")
    dealt.write.format("workbook").mode("append").option("sheetcolumn", "sheet").save(path)
    back = spark.read.format("workbook").schema(rows.schema).option("sheetcolumn", "sheet").load(path)
    return back.withColumn("day", F.col("day").cast("string")).withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT 'Sheet1' AS sheet, l_orderkey AS id, array_to_string(brands, '; ') AS factors, array_to_string(list_filter(list_transform(brands, lambda x: {_CODE}), lambda x: x IS NOT NULL), ' ') AS codes FROM ({_LISTS}) UNION ALL SELECT 'parts', p_partkey, p_name, NULL FROM part")
def sheet_rewrite(spark, sf):
    """All sheets stored, read, and stored again with a column of codes that only the first one fills."""
    path = new_folder(spark, "sheets")
    one = _order_lists(spark, sf).select(F.lit("Sheet1").alias("sheet"), F.col("l_orderkey").alias("id"), F.array_join("brands", "; ").alias("factors"))
    two = read(spark, sf, "part").select(F.lit("parts").alias("sheet"), F.col("p_partkey").alias("id"), F.col("p_name").alias("factors"))
    writers.write_sheets(one.unionByName(two), f"{path}/in")
    codes = encode.factor_codes(tx.split_labels(F.col("factors")), SUB_BY_BRAND)
    writers.add_sheet_column(readers.read_sheets(spark, f"{path}/in"), f"{path}/out", "codes", codes)
    return readers.read_sheets(spark, f"{path}/out").select("sheet", "id", "factors", "codes")


@query(f"""
WITH b AS ({_BLOBS}), s AS (SELECT doc_id, string_split(text, 'Case') AS parts FROM b), e AS (SELECT doc_id, unnest(range(len(parts))) AS seg_no, parts FROM s), t AS (SELECT trim(parts[seg_no + 1], ' ' || chr(10)) AS segment FROM e)
SELECT 'Case' || segment AS segment, CAST(count(*) AS BIGINT) AS n FROM t WHERE regexp_matches(segment, '^[0-9]') GROUP BY 1""")
def case_files(spark, sf):
    """Segments in ordered files with the separator between them, split again."""
    path = new_folder(spark, "cases")
    line = F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit(" status "), F.col("o_orderstatus"), F.lit("\n"))
    writers.write_cases(tx.split_cases(_blobs(spark, sf, "preamble", line, "")), path, files=8)
    return readers.read_cases(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS \"Part No\", p_name || ' \"' || p_brand || '\",' || chr(10) || 'x' AS cause, p_retailprice AS price FROM part")
def csv_round_trip(spark, sf):
    """CSV with a byte order mark, titles with blanks, quotes, commas and line breaks."""
    path = new_folder(spark, "csv")
    part = read(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit('",\nx')).alias("cause"), F.col("p_retailprice").alias("price"))
    writers.write_csv(part, path, {"p_partkey": "Part No"}, byte_order_mark=True)
    return readers.read_csv(spark, path, schema="`Part No` long, cause string, price double")


@query(f"SELECT CAST(case_id AS BIGINT) AS case_id, {', '.join(f'CAST(\"{c}\" AS BIGINT) AS \"{c}\"' for c in MAIN_BY_TYPE.codes)} FROM ({_MAIN_WIDE})")
def json_round_trip(spark, sf):
    path = new_folder(spark, "json")
    wide = encode.multi_hot(_masks(spark, sf, MAIN_BY_TYPE), MAIN_BY_TYPE)
    writers.write_json(wide, path)
    return spark.read.schema(wide.schema).json(path)
