from shelfcast.operators import products as pr
from shelfcast.operators.cube import fact_cube
from shelfcast.operators import series as se
from shelfcast.operators.scope import ALL


def _trend(s):
    f = fact_cube(s)
    return pr.product_trend(f, se.daily_sales(f))


def test_abc_ties(make_sales):
    s = make_sales([("S", "2024-01-01", "a", m, "g", 1.0, 1, amt)
                    for m, amt in [("m1", 50), ("m2", 30), ("m4", 10), ("m3", 10)]])
    rows = (pr.abc_classify(_trend(s)).filter(f"store = 'S' and segment = 'g'")
            .orderBy("cumulative_pct").collect())
    assert [(r.model, round(r.cumulative_pct), r.abc_class) for r in rows] == [
        ("m1", 50, "A"), ("m2", 80, "A"), ("m3", 90, "B"), ("m4", 100, "C")]


def test_abc_dominant(make_sales):
    s = make_sales([("S", "2024-01-01", "a", "x", "g", 1.0, 1, 90), ("S", "2024-01-01", "a", "y", "g", 1.0, 1, 10)])
    rows = pr.abc_classify(_trend(s)).filter("store = 'S' and segment = 'g'").orderBy("model").collect()
    assert [r.abc_class for r in rows] == ["B", "C"]


def test_half_day_midpoint(make_sales):
    s = make_sales([("S", d, "a", "m", "g", 1.0, q, q) for d, q in
                    [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 4), ("2024-01-04", 8)]])
    r = _trend(s).filter("store = 'S' and segment = 'g'").collect()[0]
    assert (r.period1_qty, r.period2_qty) == (3.0, 12.0)
    assert r.change_pct == 300.0 and r.stability == 0.0


def test_new_model_change_zero(make_sales):
    s = make_sales([("S", "2024-01-01", "a", "old", "g", 1.0, 1, 1), ("S", "2024-01-10", "a", "new", "g", 1.0, 5, 5),
                    ("S", "2024-01-10", "a", "old", "g", 1.0, 1, 1)])
    r = _trend(s).filter("store = 'S' and segment = 'g' and model = 'new'").collect()[0]
    assert r.period1_qty == 0 and r.change_pct == 0.0 and r.stability == 100.0


def test_null_store_only_in_all_levels(make_sales):
    s = make_sales([(None, "2024-01-01", "a", "m", "g", 1.0, 2, 2), ("S", "2024-01-01", "a", "m", "g", 1.0, 3, 3)])
    d = {(r.store, r.segment): r.y for r in se.daily_sales(fact_cube(s)).collect()}
    assert d == {("S", "g"): 3.0, ("S", ALL): 3.0, (ALL, "g"): 5.0, (ALL, ALL): 5.0}


def test_rollup_sums_equal_parts(spark):
    from shelfcast.sources import tpch
    s = tpch.sales_view(spark, "/root/testdata/sf0.001")
    d = se.daily_sales(fact_cube(s))
    by = {(r.store, r.segment): r.q for r in d.groupBy("store", "segment").agg({"y": "sum"})
          .withColumnRenamed("sum(y)", "q").collect()}
    total = by[(ALL, ALL)]
    assert abs(sum(v for (st, sg), v in by.items() if st != ALL and sg != ALL) - total) < 1e-6
    assert abs(sum(v for (st, sg), v in by.items() if st == ALL and sg != ALL) - total) < 1e-6


def test_line_window_sums_exact_under_skew(make_sales):
    # 40 lines on one day and 5 on the next: the first 30 lines by key all fall on day one
    rows = [("S", "2024-01-01", f"a{i:02d}", "m", "g", 1.0, i, i) for i in range(40)]
    rows += [("S", "2024-01-02", f"b{i}", "m", "g", 1.0, 100, 100) for i in range(5)]
    s = make_sales(rows)
    r = pr.line_window_sums(s, 30).filter("store = 'S' and segment = 'g'").collect()[0]
    assert r.first_qty == sum(range(30))
    assert r.last_qty == 500 + sum(range(15, 40))
