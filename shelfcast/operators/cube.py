"""The fact cube: sale lines combined once to the finest grain the scoped
operators need.

One row per ``(store, segment, model, article, day)`` with additive measures.
Daily series, monthly tables, product tables, distinct-article counts and
per-scope KPIs are all derived from it, so the sale lines are scanned and
shuffled once per run instead of once per operator. The map-side partial
aggregate combines lines before the shuffle; a hot store or day only makes
its hash partitions larger by its number of distinct (model, article) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.scope import ALL

CUBE_KEYS = ("store", "segment", "model", "article", "ds")


def fact_cube(sales: DataFrame) -> DataFrame:
    """qty, amount (NULL if every amount is NULL), lines, non-null amount lines, price sum."""
    return (sales.groupBy("store", "segment", "model", "article", F.col("sale_date").alias("ds"))
                 .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"),
                      F.count(F.lit(1)).alias("lines"), F.count("amount").alias("amount_lines"),
                      F.sum("price").alias("price_sum")))


def line_facts(sales: DataFrame) -> DataFrame:
    """The sale lines in the cube's columns, uncombined (``lines`` = 1).

    Every operator that reads the cube aggregates again by its own keys, so it
    gives the same results on this projection. A plan that reads the facts
    once uses it and skips the cube's own shuffle; runs that share the facts
    between many outputs build (and keep) the cube instead.
    """
    return sales.select(
        "store", "segment", "model", "article", F.col("sale_date").alias("ds"),
        F.col("qty").cast("decimal(28,6)").alias("qty"), F.col("amount").cast("decimal(28,6)").alias("amount"),
        F.lit(1).cast("long").alias("lines"),
        F.when(F.col("amount").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("amount_lines"),
        F.col("price").alias("price_sum"))


def model_days(facts: DataFrame) -> DataFrame:
    """The facts without articles: one row per ``(store, segment, model, day)``, in the cube's other columns.

    Bounded by models and calendar, not by sales; what needs no article gives
    the same results on it.
    """
    return (facts.groupBy("store", "segment", "model", "ds")
                 .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.sum("lines").alias("lines"),
                      F.sum("amount_lines").alias("amount_lines"), F.sum("price_sum").alias("price_sum")))


def _article_pairs(facts: DataFrame, period: Column, name: str) -> DataFrame:
    """(period, article, _pairs): the distinct (store, segment) pairs that sold the article in that period."""
    return (facts.where(F.col("article").isNotNull()).groupBy(period.alias(name), "article")
            .agg(F.collect_set(F.struct("store", "segment")).alias("_pairs")))


def _scopes_of_pairs() -> Column:
    """The distinct scopes, at all four levels, of the pairs of a row."""
    def levels(p: Column) -> Column:
        return F.array(*[F.struct(s.alias("store"), g.alias("segment"))
                         for s in (p["store"], F.lit(ALL)) for g in (p["segment"], F.lit(ALL))])
    return F.array_distinct(F.flatten(F.transform("_pairs", levels)))


def article_scopes(facts: DataFrame, period: Column, name: str) -> DataFrame:
    """(store, segment, period): one row per scope, period and distinct article sold in it.

    Lines meet once, by (period, article), where only the distinct (store,
    segment) pairs are kept; these say for which scopes the article counts in
    that period, at all four levels. Counts of the result are combined in the
    task that makes it, so no article row is shuffled again.
    """
    return (_article_pairs(facts, period, name).select(F.explode(_scopes_of_pairs()).alias("_scope"), name)
            .select("_scope.*", name)
            .filter(F.col("store").isNotNull() & F.col("segment").isNotNull()))


def article_counts(facts: DataFrame, period: Column, name: str, articles: str) -> DataFrame:
    """(store, segment, period, articles): distinct articles, as counted from the rows of ``article_scopes``.

    Articles that were sold by the same pairs in a period are counted together
    before they are fanned out, so the levels are listed once for each such
    set of pairs and not for each article.
    """
    alike = (_article_pairs(facts, period, name).groupBy(name, F.sort_array("_pairs").alias("_pairs"))
             .agg(F.count(F.lit(1)).alias("_n")))
    return (alike.select(F.explode(_scopes_of_pairs()).alias("_scope"), name, "_n").select("_scope.*", name, "_n")
            .filter(F.col("store").isNotNull() & F.col("segment").isNotNull())
            .groupBy("store", "segment", name).agg(F.sum("_n").alias(articles)))
