"""Hot keys, large numbers, caches and folders."""

import gc
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfcast.operators import elasticity as el
from shelfcast.operators import forecast as fo
from shelfcast.operators import ordered
from shelfcast.operators import products as pr
from shelfcast.operators import scope as sc
from shelfcast.operators import series as se
from shelfcast.operators import cube
from shelfcast.operators.cube import fact_cube
from shelfcast.plans.report import run_report
from shelfcast.session import ensure_checkpoint_dir
from shelfcast.sources import snapshot, tpch

SF = "/root/testdata/sf0.001"


def test_series_of_ten_billion_a_day(spark, make_daily):
    rng = np.random.default_rng(0)
    daily = make_daily(1e10 + rng.normal(0, 1e9, 120))
    prepared = se.prepare_series(daily)
    fc = fo.forecast(fo.fit_seasonal_index(prepared), 30)
    rows = fo.scenarios(fc).collect()
    assert len(rows) == 30 and all(r.realistic > 2**32 for r in rows)
    kpis = fo.forecast_kpis(fc, daily, se.segment_volatility(daily), 30).collect()[0]
    assert kpis.total_forecast > 1e11


@pytest.mark.parametrize("name", ["rule_hits", "forecast_kpis", "line_window_sums", "align_periods", "product_trend"])
def test_nothing_stays_persisted(spark, name):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = entry.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    del df
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_plans_read_the_lines_once(spark):
    def scans(name):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("l_extendedprice#")and sum("l_partkey" in x and "Relation" in x for x in plan.splitlines())
    assert scans("line_window_sums") == 3  # both ends, each cut down before its shuffle, and the count
    assert scans("min_rows_guard") == 1
    assert scans("align_periods") == 2 and scans("monthly_sales") == 2  # the second makes the daily series


def test_hot_model_percentiles(spark):
    rng = random.Random(5)
    lines = [("hot", round(rng.lognormvariate(3, 1.2), 2), float(rng.randint(1, 9))) for _ in range(6000)]
    lines += [("warm", float(rng.choice([1, 2, 5])), 2.0) for _ in range(60)] + [("one", 3.0, 1.0)] * 30
    sales = spark.createDataFrame(lines, "model string, price double, qty double").withColumn("amount", F.col("price") * F.col("qty"))
    pm = sales.groupBy("model", "price").agg(F.count("*").alias("lines"))
    got = {r.model: r for r in el.price_edges(pm.checkpoint(), bound=20, steps=16).collect()}
    for model in ("hot", "warm", "one"):
        p = np.sort([x[1] for x in lines if x[0] == model])
        assert got[model]._q == pytest.approx(np.quantile(p, [0, 1 / 3, 2 / 3, 1]).tolist())
        assert got[model]._med == pytest.approx(np.quantile(p, 0.5)) and got[model].model_lines == len(p)
    # no window over a whole model, and no buffer of all its prices
    plan = el.price_bins(sales)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


@pytest.mark.parametrize("outlier", [1e9, 1e300, 1e-300, -1e9])
def test_an_outlier_moves_no_other_price(spark, outlier):
    """Refinement looks into the intervals of the wanted ranks only; none of more than the bound is sorted."""
    rng = random.Random(8)
    prices = [round(10 + rng.random(), 4) for _ in range(5000)] + [outlier]
    pm = spark.createDataFrame([("m", p) for p in prices], "model string, price double").groupBy("model", "price").agg(F.count("*").alias("lines")).checkpoint()
    for options in ({}, {"bound": 50, "steps": 8}):
        r = el.price_edges(pm, **options).collect()[0]
        assert r._q == pytest.approx(np.quantile(prices, [0, 1 / 3, 2 / 3, 1]).tolist(), rel=1e-12) and r._med == pytest.approx(np.quantile(prices, 0.5))


def test_ranks_of_zero_negative_and_equal_values(spark):
    values = [-5.0, -5.0, -0.25, 0.0, 0.0, 1e-9, 3.0, 3.0, 3.0, 7.5]
    rows = spark.createDataFrame([("g", v) for v in values] + [("h", 2.0)], "k string, v double").groupBy("k", "v").agg(F.count("*").alias("w")).checkpoint()
    ranks = [F.lit(i) for i in range(10)]
    got = {r.k: r for r in ordered.values_at_ranks(rows, "k", "v", "w", ranks, bound=1, steps=4).collect()}
    assert got["g"].at == values and got["h"].at == [2.0] + [None] * 9
    assert (got["g"].lines, got["g"].low, got["g"].high) == (10, -5.0, 7.5)


def test_equal_revenue_is_spread_over_tasks(spark):
    n = 20_000
    trend = spark.range(n).select(F.lit("*").alias("store"), F.lit("*").alias("segment"), F.format_string("m%06d", "id").alias("model"),
                                  F.lit(1.0).alias("total_qty"), F.lit(5.0).alias("total_revenue"))
    trend = trend.unionByName(trend.limit(3).withColumn("store", F.lit("S")))
    got = pr.abc_classify(trend)
    first, last = (got.orderBy(c).first() for c in ("cumulative_revenue", F.desc("cumulative_revenue")))
    assert (first.model, first.cumulative_revenue, last.model, last.cumulative_revenue) == ("m000000", 5.0, f"m{n - 1:06d}", 5.0 * n)
    assert got.where("store = '*' AND cumulative_revenue = 5.0 * (cast(substring(model, 2) AS INT) + 1)").count() == n
    ranged = ordered.running_sum(trend, ["store", "segment"], [F.desc("total_revenue"), F.col("model")], F.lit(1), partitions=8)
    per_task = trend.repartitionByRange(8, "store", "segment", F.desc("total_revenue"), "model").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < n / 4 and ranged.agg(F.max("up_to")).first()[0] == n


def test_line_ends_are_cut_before_the_shuffle(spark):
    """Every task limits each (store, segment) to n lines, then shuffles; no line is sorted whole."""
    entry.queries()["line_window_sums"](spark, SF)  # noqa: the plan below is the operator's own
    sales = tpch.sales_view(spark, SF, with_keys=True)
    plan = pr.line_window_sums(sales, 30, ["sale_date", *tpch.LINE_KEY])._jdf.queryExecution().executedPlan().toString()
    nodes = [x.strip(" +-:").lstrip("*(0123456789) ") for x in plan.splitlines()]
    exchanges = [i for i, x in enumerate(nodes) if x.startswith("Exchange hashpartitioning") and "_salt" in x]
    assert exchanges and all("WindowGroupLimit" in nodes[i + 1] and "Partial" in nodes[i + 1] for i in exchanges), plan


@pytest.mark.parametrize("name", ["forecast_kpis", "rule_hits"])
def test_intermediates_outlive_the_result_they_were_made_for(spark, name):
    """A frame derived from a result reads what the run kept, not the tables."""
    derived = entry.queries()[name](spark, SF).filter("store = '*'")
    gc.collect()
    plan = derived._jdf.queryExecution().executedPlan().toString()
    held = entry.queries()[name](spark, SF)
    assert plan.count("FileScan") == held._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 24, plan.count("FileScan")
    assert "ExistingRDD" in plan and derived.count() > 0


def test_articles_are_counted_once_per_scope_and_period(spark, make_sales):
    """Distinct articles at all four levels against sets, with shops and segments that are missing."""
    rng = random.Random(11)
    rows = [(rng.choice(["S", "T", "U", None]), f"2024-0{rng.randint(1, 3)}-0{rng.randint(1, 3)}", rng.choice(["a", "b", "c", "d", None]), "m",
             rng.choice(["g", "h", None]), 2.0, 1, 2) for _ in range(300)]
    facts = cube.line_facts(make_sales(rows))
    for period, name, key in ((F.col("ds"), "ds", lambda d: d), (F.trunc("ds", "MM"), "month", lambda d: d[:8] + "01")):
        got = {(r.store, r.segment, str(r[name])): r["count"] for r in cube.article_scopes(facts, period, name).groupBy("store", "segment", name).count().collect()}
        sets = {}
        for store, day, article, _, segment, *_ in rows:
            for scope in {(s, g) for s in (store, "*") for g in (segment, "*")}:
                if article is not None and None not in scope:
                    sets.setdefault((*scope, key(day)), set()).add(article)
        assert got == {k: len(v) for k, v in sets.items()}
    plan = cube.article_scopes(facts, F.col("ds"), "ds").groupBy("store", "segment").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by (day, article), then one count per scope and task


def test_abc_of_a_hot_scope(spark):
    rng = random.Random(6)
    rows = [("*", "*", f"m{i:05d}", 1.0, round(rng.paretovariate(0.8), 2)) for i in range(3000)] + [("*", "*", f"t{i}", 1.0, 5.0) for i in range(50)]
    rows += [("s", "g", "only", 1.0, 0.0)]
    trend = spark.createDataFrame(rows, "store string, segment string, model string, total_qty double, total_revenue double")
    got = pr.abc_classify(trend).where("store = '*'").toPandas()
    want = pd.DataFrame(rows[:-1], columns=["store", "segment", "model", "q", "r"]).sort_values(["r", "model"], ascending=[False, True])
    cum = dict(zip(want.model, want.r.cumsum()))
    assert all(abs(cum[m] - c) < 1e-6 * c for m, c in zip(got.model, got.cumulative_revenue))
    share = got.cumulative_pct
    assert (got.abc_class == np.where(share <= 80, "A", np.where(share <= 95, "B", "C"))).all()


def test_both_ends_equal_brute_force(spark, make_sales):
    rng = random.Random(7)
    rows = [(rng.choice(["S", "S", "S", "T", None]), f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"a{i}", "m",
             rng.choice(["g", "g", "h", None]), 2.0, rng.randint(0, 5), rng.choice([None, 4])) for i in range(900)]
    got = {(r.store, r.segment): r for r in pr.line_window_sums(make_sales(rows), 30, buckets=3).collect()}
    for store, segment in [("S", "g"), ("S", "*"), ("*", "g"), ("*", "*"), ("T", "h")]:
        mine = [r for r in rows if (store == "*" or r[0] == store) and (segment == "*" or r[4] == segment)]
        key = lambda r: (r[1], r[0] is not None, r[0] or "", r[4] is not None, r[4] or "", r[2])
        mine.sort(key=key)
        r = got[store, segment]
        assert r.lines == len(mine)
        assert (r.first_qty, r.last_qty) == (sum(x[6] for x in mine[:30]), sum(x[6] for x in mine[-30:]))
        assert (r.first_amount, r.last_amount) == (sum(x[7] or 0 for x in mine[:30]), sum(x[7] or 0 for x in mine[-30:]))


def test_price_of_lines_without_amounts_is_zero(make_sales):
    s = make_sales([("S", "2024-01-01", f"a{i}", "m", "g", 2.0, 1, None) for i in range(40)])
    r = pr.line_window_sums(s).where("store = 'S' and segment = 'g'").collect()[0]
    assert (r.first_price, r.last_price, r.first_amount) == (0.0, 0.0, 0.0)


def test_tail_of_a_long_horizon(spark):
    rows = [("S", "g", f"2024-{m:02d}-{d:02d}", True, float(m)) for m in (1, 2) for d in range(1, 31 if m == 1 else 30)]
    fc = spark.createDataFrame(rows, "store string, segment string, ds string, is_future boolean, yhat double")
    assert fo.tail_mean(fc).collect()[0].avg_forecast_tail == pytest.approx((1 * 1 + 2 * 29) / 30)
    assert fo.tail_mean(fc.where("ds < '2024-01-11'")).collect()[0].avg_forecast_tail == 1.0


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_selection_is_pushed_into_the_scan(spark, tmp_path):
    tpch.sales_view(spark, SF).write.parquet(str(tmp_path / "sales"))
    plan = sc.filter_scope(spark.read.parquet(str(tmp_path / "sales")), "NATION_12", "PROMO")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(store,NATION_12)" in plan and "EqualTo(segment,PROMO)" in plan


def test_report_of_one_selection_with_the_fourier_model(spark, tmp_path):
    names = run_report(spark, tpch.sales_view(spark, SF), str(tmp_path / "out"), store="NATION_12", segment="PROMO", method="fourier", snapshot=False)
    assert "rule_hits" in names and "seasonal_coefficients" not in names
    fc = spark.read.parquet(str(tmp_path / "out" / "forecast"))
    assert {r.store for r in fc.select("store").distinct().collect()} == {"NATION_12", "*"}
    assert spark.read.parquet(str(tmp_path / "out" / "forecast_accuracy")).count() == 4
    assert fact_cube(tpch.sales_view(spark, SF)).count() > 0


def odd_tables(spark, path, rows):
    """A folder of the tables of the sales view: ``rows`` lines of 40 articles, one of them in an eighth of the lines."""
    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    put("part", [(i, f' p "{i}", x ' if i % 3 else f"p{i}", f"B{i % 5}", f"T{i % 4}") for i in range(40)],
        "p_partkey long, p_name string, p_brand string, p_type string")
    put("supplier", [(i, i % 3) for i in range(6)], "s_suppkey long, s_nationkey int")
    put("nation", [(0, "N0"), (1, "N,1"), (2, None)], "n_nationkey int, n_name string")
    i = F.col("id")
    (spark.range(rows).select(
        i.alias("l_orderkey"), F.when(i % 8 == 0, 7).otherwise(i % 40).alias("l_partkey"), (i % 6).alias("l_suppkey"),
        (i % 7).cast("int").alias("l_linenumber"), (1 + i % 9).cast("double").alias("l_quantity"),
        (10 + i % 50).cast("double").alias("l_extendedprice"),
        F.timestamp_seconds(F.lit(820_000_000) + (i * 31 % 400) * 86_400).cast("timestamp_ntz").alias("l_shipdate"))
     .write.parquet(f"{path}/lineitem.parquet"))
    return path


def fixed_deals(spark, run):
    """Calls of ``repartition`` with a fixed number of partitions while ``run`` runs."""
    seen = []

    def watched(self, *args, **options):
        if args and isinstance(args[0], int):
            seen.append(args)
        return real(self, *args, **options)
    frame = type(spark.range(0))
    real = frame.repartition
    frame.repartition = watched
    try:
        run()
    finally:
        frame.repartition = real
    return seen


@pytest.mark.parametrize("rows", [0, 4000])
def test_ragged_lines_are_written_by_the_tasks_that_made_them(spark, tmp_path, rows):
    """Not dealt to a fixed number of tasks, which would grow with the table; every line is there, whole."""
    tables, path = odd_tables(spark, str(tmp_path / "in"), rows), str(tmp_path / "lines")
    assert not fixed_deals(spark, lambda: tpch.write_dirty_lines(spark, tables, path))
    found = [f.read_text().splitlines() for f in (tmp_path / "lines").glob("file=*/*.csv")]
    assert found and all(f[0] == "Magazin,Datasales,Art,Describe,Model,Segment,Price,Qty,Sum" for f in found)
    lines = [x for f in found for x in f[1:]]
    dirty = tpch._dirty_rows(spark, tables)
    cells = F.struct(*[c for c in dirty.columns if c != "k"])
    want = [r.line + ",extra" if r.k == 22 else r.short if r.k == 23 else r.line
            for r in dirty.select("k", F.to_csv(cells).alias("line"), F.to_csv(F.struct(*dirty.columns[:5])).alias("short")).collect()]
    assert sorted(lines) == sorted(want) and len(lines) == rows
    if rows:
        outcomes = {r.outcome: r.lines for r in entry.queries()["csv_line_outcomes"](spark, tables).collect()}
        assert sum(outcomes.values()) == rows and outcomes["bad_line"] > 0


def test_the_stream_takes_files_of_the_tasks_that_made_them(spark, tmp_path, monkeypatch):
    """The export is not dealt to four tasks; it comes in at least four turns, also from one task, and is whole."""
    from shelfcast.plans import catalog
    tables, turns = odd_tables(spark, str(tmp_path / "in"), 4000), []

    def start(*args, **options):
        files = snapshot.count_files(spark, args[1].rpartition("/")[0], ".csv")
        turns.append(-(-files // options["max_files_per_trigger"]))
        return started(*args, **options)
    started = catalog.start_ingest
    monkeypatch.setattr(catalog, "start_ingest", start)
    out = []
    assert not fixed_deals(spark, lambda: out.append(entry.queries()["snapshot_batch_and_stream"](spark, tables)))
    want = entry.queries()["load_sales"](spark, tables)
    plain = lambda df: sorted(map(str, df.withColumn("description", F.trim("description")).collect()))
    assert plain(out[0]) == plain(want)  # blanks around a CSV cell are not kept
    assert 4 <= turns[0] <= 7


def test_alike_articles_are_fanned_out_together(spark, make_sales):
    """400 articles of two sets of pairs: the levels are listed twice a month, not 400 times."""
    rows = [("S", f"2024-01-0{1 + i % 5}", f"a{i}", "m", "g", 2.0, 1, 2) for i in range(400)]
    rows += [(s, "2024-01-09", f"a{i}", "m", g, 2.0, 1, 2) for i in range(0, 400, 4) for s, g in (("*", "g"), (None, "h"), ("T", None))]
    facts = cube.line_facts(make_sales(rows))
    counts = cube.article_counts(facts, F.trunc("ds", "MM"), "month", "n")
    want = cube.article_scopes(facts, F.trunc("ds", "MM"), "month").groupBy("store", "segment", "month").agg(F.count("*").alias("n"))
    assert sorted(counts.collect()) == sorted(want.collect()) and counts.filter("n = 400").count() == 4
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("sort_array")  # the fan-out is above the combine by pairs


def test_rules_read_the_lines_three_times(spark, monkeypatch):
    """Model days, articles of the months and line ends; all else is read from what is kept."""
    from shelfcast.plans import catalog
    from shelfcast.plans.context import SalesContext
    c = catalog.ctx(spark, SF, "checkpoint", only=catalog.RULE_KEEP)
    reads, real = [], SalesContext.keep

    def keep(self, df, name=""):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(self, df, name)
    monkeypatch.setattr(SalesContext, "keep", keep)
    reads.append(catalog.rule_indicators(c)._jdf.queryExecution().optimizedPlan().toString())
    assert sum("l_partkey" in x and "Relation" in x for plan in reads for x in plan.splitlines()) == 3


def test_line_ends_from_the_daily_series(spark):
    """Days that can't hold an end are left out; lines without a store, segment or date, or of a reserved name, stay."""
    rng = random.Random(11)
    rows = [(rng.choice(["S", "T", "*", None]), rng.choice(["g", "h", None]), rng.choice([None] + [f"2024-0{m}-1{d}" for m in range(1, 9) for d in range(9)]),
             i, float(rng.randint(1, 9)), rng.choice([None, 5.0, 7.0])) for i in range(3000)]
    rows += [("hot", "g", "2024-03-03", 9000 + i, 1.0, 2.0) for i in range(500)] + [("few", "g", "2024-03-03", 9900 + i, 1.0, 2.0) for i in range(5)]
    sales = spark.createDataFrame(rows, "store string, segment string, d string, k long, q double, a double").selectExpr(
        "store", "segment", "cast(d as date) sale_date", "k", "'x' article", "'m' model", "1.0D price", "cast(q as decimal(28,6)) qty", "cast(a as decimal(28,6)) amount")
    daily = se.daily_sales(cube.line_facts(sales)).checkpoint()
    kept = []
    got = pr.line_window_sums(sales, 30, ["sale_date", "k"], daily=daily, keep=lambda df: kept.append(df) or df)
    assert sorted(got.collect()) == sorted(pr.line_window_sums(sales, 30, ["sale_date", "k"]).collect())
    named = "store in ('S', 'T') and segment is not null and sale_date is not null"
    assert 0 < kept[0].filter(named).count() < sales.filter(named).count() / 2
    broad, pr.BROADCAST_PAIRS = pr.BROADCAST_PAIRS, 0
    try:
        assert sorted(pr.line_window_sums(sales, 30, ["sale_date", "k"], daily=daily).collect()) == sorted(got.collect())
    finally:
        pr.BROADCAST_PAIRS = broad
