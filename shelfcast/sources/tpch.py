"""The ``sales`` view over the driver's TPC-H style tables.

Stores are supplier nations, segments part types, models brand + type, and
articles part keys. The join order and strategy are left to Catalyst and AQE:
the dimension sides are broadcast only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise they are sort-merge joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.sources.sales import MONEY

# Columns that, with ``sale_date``, identify a line of the view uniquely.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table; round-robined over ``shelfcast.bench.scanPartitions`` tasks if the session sets it.

    Off unless set: a cluster reads many files, and the extra shuffle would only
    cost. The bench sets it, since its fact file is one row group.
    """
    scan = table(spark, sf_dir, "lineitem")
    spread = spark.conf.get("shelfcast.bench.scanPartitions", None)
    return scan.repartition(int(spread)) if spread else scan


def sales_view(spark: SparkSession, sf_dir: str, with_keys: bool = False) -> DataFrame:
    """Canonical sales table built from lineitem, part, supplier, nation."""
    li = fact_scan(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    joined = (li.join(part, li.l_partkey == part.p_partkey)
                .join(supplier, li.l_suppkey == supplier.s_suppkey)
                .join(nation, supplier.s_nationkey == nation.n_nationkey))
    cols = [
        F.col("n_name").alias("store"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_partkey").cast("string").alias("article"),
        F.col("p_name").alias("description"),
        F.concat_ws(" ", "p_brand", "p_type").alias("model"),
        F.col("p_type").alias("segment"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
    ]
    if with_keys:
        cols += [F.col(c) for c in LINE_KEY]
    return joined.select(*cols)


def dirty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine source columns as text, with a deterministic 1-in-50 dirt mix.

    ``k = (l_orderkey + l_partkey) % 50`` picks the change; see FIXTURES.md.
    Used to exercise the ingest rules on the driver's tables.
    """
    return _dirty_rows(spark, sf_dir).drop("k")


def write_dirty_lines(spark: SparkSession, sf_dir: str, path: str, files: int = 8) -> None:
    """The dirty rows as CSV files with a header, some lines of which don't fit it.

    Lines of ``k = 22`` have an extra cell, lines of ``k = 23`` end after five.
    They are dealt over ``files`` folders. Each task writes its own lines there,
    so no task holds more of them than it has read.
    """
    rows = _dirty_rows(spark, sf_dir)
    cells = [c for c in rows.columns if c != "k"]
    line = (F.when(F.col("k") == 22, F.concat(F.to_csv(F.struct(*cells)), F.lit(",extra")))
             .when(F.col("k") == 23, F.to_csv(F.struct(*cells[:5]))).otherwise(F.to_csv(F.struct(*cells))))
    header = ",".join(cells)
    lines = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file"), line.alias(header))
    # written as CSV of one column whose name is the header: no cell is quoted or trimmed again
    as_they_are = {"header": True, "sep": "\u0001", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # a file of the header alone, for tables without lines
    spark.createDataFrame([], T.StructType([T.StructField(header, T.StringType())])).write.options(**as_they_are).csv(f"{path}/file=0")
    lines.write.mode("append").partitionBy("file").options(**as_they_are).csv(path)


def _dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales_view(spark, sf_dir, with_keys=True)
    k = (F.col("l_orderkey") + F.col("l_partkey")) % 50
    # price to 6 decimals, rounded half up, from whole cents and an integer
    # quantity, so the text does not depend on how an engine rounds doubles
    cents = F.round(F.col("amount") * 100).cast("long")
    q = F.col("qty").cast("long")
    micro = F.floor((cents * 20000 + q) / (q * 2)).cast("long")
    price_txt = F.concat(F.floor(micro / 1000000).cast("long").cast("string"), F.lit("."),
                         F.lpad((micro % 1000000).cast("string"), 6, "0"))
    qty_txt = F.col("qty").cast("decimal(18,2)").cast("string")
    amount_txt = F.col("amount").cast("decimal(18,2)").cast("string")
    layouts = {6: "dd/MM/yyyy", 7: "yyyy-MM-dd", 17: "dd-MM-yyyy", 18: "dd.MM.yy", 19: "dd/MM/yyyy '10:00:00'",
               20: "yyyy-MM-dd'T10:00:00'", 21: "dd.MM.yyyy '10:30'"}
    date_txt = F.when(k == 5, F.lit("unknown"))
    for n, layout in layouts.items():
        date_txt = date_txt.when(k == n, F.date_format("sale_date", layout))
    date_txt = date_txt.otherwise(F.date_format("sale_date", "dd.MM.yyyy"))
    price = (F.when(k == 0, F.lit("n/a")).when(k == 1, F.lit("0"))
              .when(k == 9, F.lit("1,5")).when(k == 10, F.lit("nan"))
              .when(k == 11, F.lit("12.5d")).otherwise(price_txt))
    qty = (F.when(k == 2, F.lit("-1")).when(k == 3, F.lit("0"))
            .when(k == 8, F.concat(F.lit("  "), qty_txt, F.lit(" ")))
            .when(k == 12, F.lit("-0.004")).when(k == 13, F.lit("0.125")).when(k == 15, F.lit("1e23")).otherwise(qty_txt))
    amount = (F.when(k == 4, F.lit("")).when(k == 14, F.lit("1e16")).when(k == 16, F.lit("1e30")).otherwise(amount_txt))
    return s.select(
        F.col("store").alias("Magazin"), date_txt.alias("Datasales"),
        F.col("article").alias("Art"), F.col("description").alias("Describe"),
        F.col("model").alias("Model"), F.col("segment").alias("Segment"),
        price.alias("Price"), qty.alias("Qty"), amount.alias("Sum"), k.alias("k"),
    )


def events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the nine source columns, with native types.

    Event type plays the store and the model, the user the article, one event
    is one unit sold at ``value``. Timestamps are intraday, so a day-grain
    loader must not split a day into many rows.
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("Magazin"), F.col("ts").alias("Datasales"),
        F.col("user_id").cast("string").alias("Art"), F.col("props").alias("Describe"),
        F.col("event_type").alias("Model"), F.lit("events").alias("Segment"),
        F.col("value").alias("Price"), F.lit(1).alias("Qty"), F.col("value").alias("Sum"))
