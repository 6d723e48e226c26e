"""SURVEY §5 layer 3: invariants on the driver's sf0.001 tables."""

from pyspark.sql import functions as F

import shelfcast.plans.catalog as cat
from shelfcast.operators import series as se
from shelfcast.operators.cube import fact_cube
from shelfcast.sources import tpch

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_partition_count_and_input_order_do_not_matter(spark):
    base = _rows(cat.QUERIES["product_trend"](spark, SF))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        shuffled = tpch.sales_view(spark, SF).orderBy(F.rand(7)).repartition(5)
        f = fact_cube(shuffled)
        from shelfcast.operators import products as pr
        other = _rows(pr.product_trend(f, se.daily_sales(f)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == other


def test_shares_sum_to_100(spark):
    wd = cat.QUERIES["weekday_sales"](spark, SF).groupBy("store", "segment").agg(F.sum("qty_pct").alias("s"))
    assert all(abs(r.s - 100) < 1e-6 for r in wd.collect())
    abc = cat.QUERIES["abc_summary"](spark, SF).groupBy("store", "segment").agg(F.sum("revenue_share_pct").alias("s"))
    assert all(abs(r.s - 100) < 0.02 for r in abc.collect())


def test_clipped_values_inside_bounds(spark):
    w = cat.QUERIES["winsorize_iqr"](spark, SF)
    q = (cat.QUERIES["daily_sales"](spark, SF).groupBy("store", "segment")
         .agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n")))
    j = w.join(q, ["store", "segment"]).filter("n >= 4")
    bad = j.filter((F.col("y") > F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]) + 1e-9) |
                   (F.col("y") < F.greatest(F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0]), F.lit(0.0)) - 1e-9))
    assert bad.count() == 0


def test_abc_classes_in_order(spark):
    from pyspark.sql import Window
    a = cat.QUERIES["abc_classify"](spark, SF)
    w = Window.partitionBy("store", "segment").orderBy(F.col("total_revenue").desc(), "model")
    prev = a.withColumn("prev", F.lag("abc_class").over(w)).filter("prev is not null")
    assert prev.filter("prev > abc_class").count() == 0


def test_forecast_bounds_and_nonnegative(spark):
    fc = cat.QUERIES["forecast_seasonal_index"](spark, SF)
    assert fc.filter("yhat < 0 or yhat_lower < 0 or yhat_lower > yhat or yhat > yhat_upper").count() == 0
    per_scope = fc.filter("is_future").groupBy("store", "segment").count()
    assert per_scope.filter("count <> 30").count() == 0
