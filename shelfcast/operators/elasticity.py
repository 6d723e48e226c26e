"""Price elasticity per model over the whole table.

Lines are first combined to ``(model, price)`` with counts, kept in a reliable
checkpoint. Exact weighted percentiles come from rank refinement
(``ordered.values_at_ranks``): prices are counted by interval, and only the
intervals that hold a wanted rank are looked into. No task holds a whole
model, however many lines or distinct prices it has, or how far apart they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.joins import salted_join
from shelfcast.operators.ordered import values_at_ranks
from shelfcast.session import ensure_checkpoint_dir

#: Inner edges: the terciles and the median, as shares of a model's lines.
SHARES = (1.0 / 3.0, 2.0 / 3.0, 0.5)


def price_edges(pm: DataFrame, **options) -> DataFrame:
    """(model, model_lines, _q, _med): price at ranks 0, 1/3, 2/3, 1 and 1/2 of a model's lines, interpolated.

    ``pm``: (model, price, lines), kept by the caller.
    """
    places = [F.lit(p) * (F.col("lines") - 1) for p in SHARES]
    found = values_at_ranks(pm, "model", "price", "lines", [f(x) for x in places for f in (F.floor, F.ceil)], **options)

    def between(i):
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        return F.when(low == high, low).otherwise((F.ceil(places[i]) - places[i]) * low + (places[i] - F.floor(places[i])) * high)

    return found.select("model", F.col("lines").alias("model_lines"), F.array("low", between(0), between(1), "high").alias("_q"),
                        between(2).alias("_med"))


def price_bins(sales: DataFrame, min_lines: int = 10) -> DataFrame:
    """H5 + C3: per (model, price) with the model's bin edges and bin.

    Terciles when the four tercile edges are strictly increasing, else halves
    when min < median < max, else the model is skipped; models with fewer than
    ``min_lines`` lines are skipped. Bins are right-closed: ``low`` is
    ``price <= e1``, ``high`` is ``price > e2`` (both edges the median for halves).
    """
    pm = (sales.where(F.col("model").isNotNull() & F.col("price").isNotNull())
               .groupBy("model", "price")
               .agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("qty"),
                    F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,6)")).alias("amount")))
    ensure_checkpoint_dir(sales.sparkSession)
    pm = pm.checkpoint()
    e = salted_join(pm, price_edges(pm), ["model"])
    terciles = (F.col("_q")[0] < F.col("_q")[1]) & (F.col("_q")[1] < F.col("_q")[2]) & (F.col("_q")[2] < F.col("_q")[3])
    halves = (F.col("_q")[0] < F.col("_med")) & (F.col("_med") < F.col("_q")[3])
    bins = F.when(F.col("model_lines") < min_lines, None).when(terciles, 3).when(halves, 2)
    e = e.withColumn("bins", bins).filter(F.col("bins").isNotNull())
    e1 = F.when(F.col("bins") == 3, F.col("_q")[1]).otherwise(F.col("_med"))
    e2 = F.when(F.col("bins") == 3, F.col("_q")[2]).otherwise(F.col("_med"))
    price_bin = F.when(F.col("price") <= e1, "low").when(F.col("price") > e2, "high").otherwise("mid")
    return e.select("model", "price", "lines", "qty", "amount", "model_lines", "bins",
                    e1.alias("edge_low"), e2.alias("edge_high"), price_bin.alias("price_bin"))


def price_elasticity(bins: DataFrame) -> DataFrame:
    """H6 + H7: elasticity between the outer bins and its class.

    ``(qty change %) / (mean price change %)`` from the low to the high bin.
    A zero low-bin quantity gives NULL elasticity and class ``undefined``.
    Also the model's unweighted mean line price, revenue and quantity.
    """
    def bin_sum(name, expr):
        return F.sum(F.when(F.col("price_bin") == name, expr))

    g = bins.groupBy("model").agg(
        F.first("bins").alias("bins"), F.sum("lines").alias("lines"),
        (F.sum(F.col("price") * F.col("lines")) / F.sum("lines")).alias("avg_price"),
        F.sum("amount").cast("double").alias("total_revenue"),
        F.sum("qty").cast("double").alias("total_qty"),
        (bin_sum("low", F.col("price") * F.col("lines")) / bin_sum("low", F.col("lines"))).alias("low_price"),
        (bin_sum("high", F.col("price") * F.col("lines")) / bin_sum("high", F.col("lines"))).alias("high_price"),
        F.coalesce(bin_sum("low", F.col("qty")), F.lit(0)).cast("double").alias("low_qty"),
        F.coalesce(bin_sum("high", F.col("qty")), F.lit(0)).cast("double").alias("high_qty"))
    price_chg = (F.col("high_price") - F.col("low_price")) / F.col("low_price") * 100
    qty_chg = F.try_divide(F.col("high_qty") - F.col("low_qty"), F.col("low_qty")) * 100
    g = (g.filter(F.col("high_price") != F.col("low_price"))
          .withColumn("price_change_pct", price_chg)
          .withColumn("qty_change_pct", qty_chg)
          .withColumn("elasticity", F.try_divide(F.col("qty_change_pct"), F.col("price_change_pct"))))
    a = F.abs("elasticity")
    cls = (F.when(F.col("elasticity").isNull(), "undefined").when(a > 1, "elastic")
            .when(a < 1, "inelastic").otherwise("unit"))
    return g.withColumn("elasticity_class", cls)


def elasticity_summary(el: DataFrame) -> DataFrame:
    """H8: counts per class; elastic and inelastic share of their joint revenue."""
    rev = lambda c: F.coalesce(F.sum(F.when(F.col("elasticity_class") == c,
                                            F.col("total_revenue").cast("decimal(38,6)"))).cast("double"), F.lit(0.0))
    s = el.agg(F.count(F.lit(1)).alias("analysed"),
               F.count_if(F.col("elasticity_class") == "elastic").alias("elastic_count"),
               F.count_if(F.col("elasticity_class") == "inelastic").alias("inelastic_count"),
               F.count_if(F.col("elasticity_class") == "unit").alias("unit_count"),
               F.count_if(F.col("elasticity_class") == "undefined").alias("undefined_count"),
               rev("elastic").alias("elastic_revenue"), rev("inelastic").alias("inelastic_revenue"))
    joint = F.col("elastic_revenue") + F.col("inelastic_revenue")
    share = lambda c: F.when(joint > 0, F.col(c) / joint * 100).otherwise(0.0)
    return s.select("*", share("elastic_revenue").alias("elastic_share_pct"),
                    share("inelastic_revenue").alias("inelastic_share_pct"))


def top_elasticity(el: DataFrame, n: int = 20) -> DataFrame:
    """the ``n`` highest-revenue analysed models (ties: model asc)."""
    return el.orderBy(F.col("total_revenue").desc(), F.col("model")).limit(n)
