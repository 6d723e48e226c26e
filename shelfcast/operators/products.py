"""Product analytics per scope.

Sale lines are combined to ``(store, segment, model, day)`` before the
fan-out to scope levels; the period of a row depends on its scope's first and
last date, so the per-scope bounds table is joined in: broadcast after a
row count, else a salted join (``functions.joins``), so neither the fanned-out
rows are shuffled for it nor the hot ``('*', '*')`` key lands on one task. Ranking windows run over
models of one scope, never over sale lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.joins import salted_join
from shelfcast.operators.cube import article_scopes
from shelfcast.operators.ordered import running_sum
from shelfcast.operators.scope import ALL, SCOPE, abc_label, expand_scopes
from shelfcast.operators.topn import top_n


#: (store, segment) pairs up to which the cuts of their lines are broadcast (under 1 MB).
BROADCAST_PAIRS = 10_000


def scope_bounds(daily: DataFrame) -> DataFrame:
    """First and last sale date per scope."""
    return daily.groupBy(*SCOPE).agg(F.min("ds").alias("first_date"), F.max("ds").alias("last_date"))


def in_second_half(ds: Column, first: Column, last: Column) -> Column:
    """H2: ``ds >= first + (last - first) / 2``, exact on half days."""
    return F.datediff(ds, first) * 2 >= F.datediff(last, first)


def product_trend(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """H1 + H3 + H4 + D21: per scope and model.

    Totals, quantity in each half of the scope's date range, change % (0 when
    the first half sold nothing), stability ``100 - min(|change|, 100)``, and
    first/last sale date with days active.
    """
    fine = (facts.where(F.col("model").isNotNull())
                 .groupBy("store", "segment", "model", "ds")
                 .agg(F.sum("qty").alias("qty"),
                      F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,6)")).alias("amount")))
    rows = salted_join(expand_scopes(fine), scope_bounds(daily), SCOPE)
    p2 = in_second_half(F.col("ds"), F.col("first_date"), F.col("last_date"))
    t = rows.groupBy(*SCOPE, "model").agg(
        F.sum("qty").cast("double").alias("total_qty"),
        F.sum("amount").cast("double").alias("total_revenue"),
        F.coalesce(F.sum(F.when(~p2, F.col("qty"))), F.lit(0)).cast("double").alias("period1_qty"),
        F.coalesce(F.sum(F.when(p2, F.col("qty"))), F.lit(0)).cast("double").alias("period2_qty"),
        F.min("ds").alias("first_sale"), F.max("ds").alias("last_sale"))
    change = (F.when(F.col("period1_qty") > 0,
                     (F.col("period2_qty") - F.col("period1_qty")) / F.col("period1_qty") * 100)
               .otherwise(0.0))
    return (t.withColumn("change_pct", change)
             .withColumn("stability", 100 - F.least(F.abs(F.col("change_pct")), F.lit(100.0)))
             .withColumn("days_active", F.datediff("last_sale", "first_sale")))


def align_periods(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """Per-model sums of each half, left-aligned to all models, missing -> 0.

    The halves are filtered sums over one pass of the combined rows, which
    gives the same rows as two aggregates joined back to the model list.
    """
    t = product_trend(facts, daily)
    return t.select(*SCOPE, "model", "total_qty", "period1_qty", "period2_qty")


def abc_classify(trend: DataFrame) -> DataFrame:
    """E8 + E9: cumulative revenue share by revenue desc (ties: model asc).

    A when the running share is <= 80, B when <= 95, else C; the product that
    crosses 80 is in B, so A can be empty.
    """
    # revenue is summed as DECIMAL so running sums do not depend on order
    ranked = running_sum(trend.select(*SCOPE, "model", "total_qty", "total_revenue"), SCOPE,
                         [F.col("total_revenue").desc(), F.col("model")], F.col("total_revenue").cast("decimal(38,6)"))
    cum = F.col("up_to").cast("double")
    share = F.try_divide(cum, F.col("total").cast("double")) * 100
    return (ranked.select(*SCOPE, "model", "total_qty", "total_revenue",
                          cum.alias("cumulative_revenue"), share.alias("cumulative_pct"))
                  .withColumn("abc_class", F.when(F.col("cumulative_pct") <= 80, "A")
                              .when(F.col("cumulative_pct") <= 95, "B").otherwise("C")))


def abc_summary(abc: DataFrame) -> DataFrame:
    """Products and revenue per class, share of revenue (2 decimals, half even)."""
    s = abc.groupBy(*SCOPE, "abc_class").agg(F.count(F.lit(1)).alias("products"),
                                              F.sum("total_revenue").alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy(*SCOPE))
    return (s.withColumn("revenue_share_pct", F.bround(F.try_divide(F.col("revenue"), total) * 100, 2))
             .withColumn("abc_label", abc_label("abc_class")))


def _rank(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*SCOPE).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_class_a(abc: DataFrame, daily: DataFrame, n: int = 10) -> DataFrame:
    """best ``n`` class-A products with their share of the scope's revenue."""
    scope_amount = daily.groupBy(*SCOPE).agg(F.sum("amount").cast("double").alias("_scope_amount"))
    a = _rank(abc.filter(F.col("abc_class") == "A"), [F.col("total_revenue").desc(), F.col("model")], n)
    return (a.join(scope_amount, list(SCOPE))
             .select(*SCOPE, "rank", "model", "total_qty", "total_revenue",
                     F.bround(F.try_divide(F.col("total_revenue"), F.col("_scope_amount")) * 100, 2)
                      .alias("revenue_share_pct")))


def top_by_revenue(trend: DataFrame, n: int = 20) -> DataFrame:
    """best ``n`` by revenue (ties: model asc) with average price."""
    t = _rank(trend, [F.col("total_revenue").desc(), F.col("model")], n)
    return t.select(*SCOPE, "rank", "model", "total_qty", "total_revenue", "change_pct", "stability",
                    F.try_divide(F.col("total_revenue"), F.col("total_qty")).alias("avg_price"))


def top_stable(trend: DataFrame, n: int = 20) -> DataFrame:
    """sold in both halves, most stable first (ties: model asc)."""
    both = trend.filter((F.col("period1_qty") > 0) & (F.col("period2_qty") > 0))
    t = _rank(both, [F.col("stability").desc(), F.col("model")], n)
    return t.select(*SCOPE, "rank", "model", "total_qty", "total_revenue",
                    F.try_divide(F.col("total_revenue"), F.col("total_qty")).alias("avg_price"),
                    "change_pct", "stability")


def top_declining(trend: DataFrame, n: int = 20) -> DataFrame:
    """falling products, steepest first (ties: model asc); ``critical`` below -50 %."""
    t = _rank(trend.filter(F.col("change_pct") < 0), [F.col("change_pct"), F.col("model")], n)
    return t.select(*SCOPE, "rank", "model", "total_qty", "period1_qty", "period2_qty", "change_pct",
                    (F.col("change_pct") < -50).alias("critical"))


def product_kpis(trend: DataFrame) -> DataFrame:
    """D24 + D25 + F6 per scope.

    Counts of growing (> 20 %), declining (< -20 %) and stable models; revenue
    share of the top 5 and top 10; the revenue leader and how many of the top
    20 grow by more than 20 %.
    """
    revenue = F.col("total_revenue").cast("decimal(38,6)")
    best = top_n(trend.select(*SCOPE, "model", "total_revenue", "change_pct"), SCOPE,
                 [F.col("total_revenue").desc(), F.col("model")], 20, rank_col="_rk")
    top = best.groupBy(*SCOPE).agg(
        F.sum(F.when(F.col("_rk") <= 5, revenue)).cast("double").alias("_top5"),
        F.sum(F.when(F.col("_rk") <= 10, revenue)).cast("double").alias("_top10"),
        F.max(F.when(F.col("_rk") == 1, F.col("model"))).alias("leader_model"),
        F.max(F.when(F.col("_rk") == 1, F.col("total_revenue"))).alias("leader_revenue"),
        F.count_if(F.col("change_pct") > 20).alias("top20_growing"))
    k = trend.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if(F.col("change_pct") > 20).alias("growing_count"),
        F.count_if(F.col("change_pct") < -20).alias("declining_count"),
        F.count_if((F.col("change_pct") >= -20) & (F.col("change_pct") <= 20)).alias("stable_count"),
        F.sum(revenue).cast("double").alias("_total")).join(top, list(SCOPE))
    return k.select(*SCOPE, "models", "growing_count", "declining_count", "stable_count",
                    (F.try_divide(F.col("_top5"), F.col("_total")) * 100).alias("top5_share_pct"),
                    (F.try_divide(F.col("_top10"), F.col("_total")) * 100).alias("top10_share_pct"),
                    "leader_model", "leader_revenue", "top20_growing")


def top_models_by_segment(facts: DataFrame, n: int = 10) -> DataFrame:
    """per store and segment, best ``n`` models by revenue (ties: model asc).

    Price is amount / qty (0 when qty <= 0). The "all" levels are included.
    """
    fine = (facts.where(F.col("model").isNotNull())
                 .groupBy("store", "segment", "model")
                 .agg(F.sum("qty").alias("qty"),
                      F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,6)")).alias("amount")))
    m = (expand_scopes(fine).groupBy(*SCOPE, "model")
         .agg(F.sum("qty").cast("double").alias("qty"), F.sum("amount").cast("double").alias("amount")))
    t = _rank(m, [F.col("amount").desc(), F.col("model")], n)
    return t.select(*SCOPE, "rank", "model", "qty", "amount",
                    F.when(F.col("qty") > 0, F.col("amount") / F.col("qty")).otherwise(0.0).alias("price"))


def scope_kpis(facts: DataFrame, daily: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """D18 + D19 + D22 + D23 per scope.

    Ticket = amount per sale line; lines per calendar day of the span; mean
    line amount (non-null amounts); sell-through = mean daily qty / mean daily
    distinct articles (0 when that is 0); unweighted mean line price;
    weighted price = amount / qty (0 when qty is 0). ``sums``: the facts
    combined without articles, where they are kept.
    """
    fine = ((facts if sums is None else sums).groupBy("store", "segment")
                 .agg(F.sum("price_sum").alias("_ps"), F.sum("lines").alias("_n"),
                      F.sum("amount").alias("_as"), F.sum("amount_lines").alias("_an")))
    lines = (expand_scopes(fine).groupBy(*SCOPE)
             .agg((F.sum("_ps") / F.sum("_n")).alias("mean_line_price"),
                  F.try_divide(F.sum("_as").cast("double"), F.sum("_an")).alias("mean_line_amount")))
    per_day = article_scopes(facts, F.col("ds"), "ds").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_art_days"))
    d = daily.groupBy(*SCOPE).agg(
        F.sum("lines").alias("lines"), F.sum("y").alias("total_qty"),
        F.sum("amount").cast("double").alias("total_amount"), F.count(F.lit(1)).alias("days"),
        F.min("ds").alias("_first"), F.max("ds").alias("_last"))
    j = d.join(lines, list(SCOPE)).join(per_day, list(SCOPE), "left")
    mean_daily_arts = F.coalesce(F.col("_art_days"), F.lit(0)) / F.col("days")
    mean_daily_qty = F.col("total_qty") / F.col("days")
    return j.select(
        *SCOPE, "lines", "total_qty", "total_amount",
        (F.col("total_amount") / F.col("lines")).alias("avg_ticket"),
        (F.col("lines") / (F.datediff("_last", "_first") + 1)).alias("lines_per_day"),
        "mean_line_amount", "mean_line_price",
        F.when(mean_daily_arts > 0, mean_daily_qty / mean_daily_arts).otherwise(0.0).alias("sell_through"),
        F.when(F.col("total_qty") > 0, F.col("total_amount") / F.col("total_qty")).otherwise(0.0)
         .alias("weighted_price"))


def dataset_overview(facts: DataFrame) -> DataFrame:
    """One row for the whole table.

    Lines, distinct articles/stores/segments, first and last date, total
    amount, and the mean over dates of the quantity sold per date (total
    quantity over the number of distinct dates). Lines are first combined per
    (store, segment, date) and per article; each distinct count then runs over
    one of those small tables, and the one-row parts are summed.
    """
    fine = facts.groupBy("store", "segment", "ds").agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    days = fine.agg(
        F.sum("lines").alias("lines"), F.lit(0).cast("long").alias("articles"),
        F.countDistinct("store").alias("stores"), F.countDistinct("segment").alias("segments"),
        F.min("ds").alias("first_date"), F.max("ds").alias("last_date"),
        F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), F.countDistinct("ds").alias("dates"))
    articles = (facts.where(F.col("article").isNotNull()).select("article").distinct()
                .agg(F.count(F.lit(1)).alias("articles")))
    both = days.unionByName(articles, allowMissingColumns=True)
    return both.agg(
        F.sum("lines").alias("lines"), F.sum("articles").alias("articles"), F.sum("stores").alias("stores"),
        F.sum("segments").alias("segments"), F.max("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"),
        F.try_divide(F.sum("qty").cast("double"), F.sum("dates")).alias("avg_daily_qty"))


def lines_near_ends(rows: DataFrame, daily: DataFrame, n: int) -> DataFrame:
    """The lines of days on which the first or last ``n`` lines of a (store, segment) can lie, by the lines of its days.

    Lines without a store, segment or date, or with the name of a roll-up
    level, all stay.
    """
    by_day, back = (Window.partitionBy(*SCOPE).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                    for o in (F.col("ds").asc_nulls_first(), F.col("ds").desc_nulls_last()))
    pairs = daily.filter((F.col("store") != ALL) & (F.col("segment") != ALL))
    cuts = (pairs.withColumn("_before", F.coalesce(F.sum("lines").over(by_day), F.lit(0)))
                 .withColumn("_after", F.coalesce(F.sum("lines").over(back), F.lit(0)))
                 .groupBy(*SCOPE).agg(F.max(F.when(F.col("_before") < n, F.col("ds"))).alias("_to"),
                                      F.min(F.when(F.col("_after") < n, F.col("ds"))).alias("_from")))
    few = pairs.select(*SCOPE).distinct().limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    near = rows.join(F.broadcast(cuts), list(SCOPE), "left") if few else salted_join(rows, cuts, SCOPE, "left")
    date = F.col("sale_date")
    return (near.filter(date.isNull() | F.col("_to").isNull() | F.col("_from").isNull()
                        | (date <= F.col("_to")) | (date >= F.col("_from"))).select(*rows.columns))


def line_window_sums(sales: DataFrame, n: int = 30, order_cols: Sequence[str] | None = None, buckets: int = 32,
                     daily: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Quantity and amount of the first and last ``n`` sale *lines* per scope.

    Lines are ordered by ``order_cols`` (default: date, then every column, so
    equal keys give equal sums). Each end is a selection of its own: every task
    leaves ``n`` lines of a (store, segment) before the shuffle (``top_n``),
    and the ``n`` left of each pair are fanned out to the scope levels, where
    the end is taken again. It is exact, since the first ``n`` lines of a scope
    are among the first ``n`` of its pairs. Lines are counted apart.

    With the ``daily`` series (kept by the caller), lines are counted from it,
    and both ends are taken from the few lines of the days that can hold them
    (``lines_near_ends``), which ``keep`` may keep, so the lines are read once.
    """
    order_cols = list(order_cols or ["sale_date", "_store0", "_segment0", "article", "model",
                                     "description", "price", "qty", "amount"])
    rows = sales.withColumn("_store0", F.col("store")).withColumn("_segment0", F.col("segment"))
    carried = list(dict.fromkeys([*order_cols, "qty", "amount"]))
    rows = rows.select(*SCOPE, *[c for c in carried if c not in SCOPE])
    if daily is not None and order_cols[0] == "sale_date":
        rows = keep(lines_near_ends(rows, daily, n))

    def end(name: str, order: Sequence[Column]) -> DataFrame:
        pairs = top_n(rows, SCOPE, order, n, buckets).drop("rank")
        ends = top_n(expand_scopes(pairs), SCOPE, order, n, buckets)
        return ends.groupBy(*SCOPE).agg(F.sum("qty").alias(f"{name}_qty"), F.coalesce(F.sum("amount"), F.lit(0)).alias(f"{name}_amount"))

    fine = rows.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("lines"))
    lines = (daily if daily is not None else expand_scopes(fine)).groupBy(*SCOPE).agg(F.sum("lines").alias("lines"))
    parts = [lines, end("first", [F.col(c).asc_nulls_first() for c in order_cols]),
             end("last", [F.col(c).desc_nulls_last() for c in order_cols])]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = stacked.groupBy(*SCOPE).agg(*[F.max(c).alias(c) for c in ("lines", "first_qty", "last_qty", "first_amount", "last_amount")])

    def price(side):
        return F.when(F.col(f"{side}_qty") > 0, F.col(f"{side}_amount").cast("double") / F.col(f"{side}_qty").cast("double")).otherwise(0.0)

    return sums.select(
        *SCOPE, "lines", *[F.col(c).cast("double").alias(c) for c in ("first_qty", "last_qty", "first_amount", "last_amount")],
        price("first").alias("first_price"), price("last").alias("last_price"))
