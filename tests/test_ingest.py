import pytest

from shelfcast.sources import sales as src


def _source(spark, rows, cols=src.REQUIRED_COLUMNS):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_missing_column_named(spark):
    cols = [c for c in src.REQUIRED_COLUMNS if c != "Segment"]
    df = _source(spark, [tuple("x" for _ in cols)], cols)
    with pytest.raises(src.MissingColumnsError) as err:
        src.load_sales(df)
    assert err.value.missing == ["Segment"]


def test_dirty_cells(spark):
    base = ["S", "03.02.2024", "A1", "d", "M", "G", "10", "2", "20"]

    def row(**kw):
        r = dict(zip(src.REQUIRED_COLUMNS, base))
        r.update(kw)
        return tuple(r[c] for c in src.REQUIRED_COLUMNS)

    cases = {
        "n/a price": (row(Price="n/a"), False),
        "zero price": (row(Price="0"), False),
        "negative qty": (row(Qty="-1"), False),
        "zero qty": (row(Qty="0"), True),
        "empty sum": (row(Sum=""), True),
        "bad date": (row(Datasales="unknown"), False),
        "slash date": (row(Datasales="15/02/2024"), True),
        "iso date": (row(Datasales="2024-02-04"), True),
        "blank qty": (row(Qty="  5 "), True),
        "comma price": (row(Price="1,5"), False),
        "nan price": (row(Price="nan"), False),
        "suffix price": (row(Price="12.5d"), False),
        "inf price": (row(Price="inf"), False),
        "exp price": (row(Price="1e3"), True),
        "slightly negative qty": (row(Qty="-0.004"), False),
        "large sum": (row(Sum="1e17"), True),
        "qty beyond the type": (row(Qty="1e23"), False),
        "sum beyond the type": (row(Sum="-1e30"), False),
        "impossible date": (row(Datasales="31.02.2024"), False),
        "impossible time": (row(Datasales="15.02.2024 25:00"), False),
    }
    for name, (r, kept) in cases.items():
        out = src.load_sales(_source(spark, [r])).collect()
        assert (len(out) == 1) == kept, name
    out = src.load_sales(_source(spark, [row(Datasales="15/02/2024", Sum="")])).collect()[0]
    assert str(out.sale_date) == "2024-02-15" and out.amount is None
    out = src.load_sales(_source(spark, [row(Price="1e3")])).collect()[0]
    assert out.price == 1000.0


def test_values_are_kept_as_written(spark):
    out = src.load_sales(_source(spark, [("S", "03.02.2024", "a", "d", "M", "G", "10", "0.125", "1e17")])).collect()[0]
    assert float(out.qty) == 0.125 and float(out.amount) == 1e17


@pytest.mark.parametrize("text", ["15-02-2024", "15.02.24", "15/02/2024 10:00:00", "2024-02-15T10:00:00", "15.02.2024 10:30",
                                  "2024/2/15", "15 02 2024", "2024-02-15T10:00:00.123+02:00", "20240215", "15-Feb-2024", " 15.2.2024 "])
def test_date_layouts(spark, text):
    row = ("S", text, "a", "d", "M", "G", "10", "1", "1")
    assert [str(r.sale_date) for r in src.load_sales(_source(spark, [row])).collect()] == ["2024-02-15"]


def test_layouts_are_a_parameter(spark):
    df = _source(spark, [("S", "02/15/2024", "a", "d", "M", "G", "10", "1", "1"), ("S", "15.02.95", "a", "d", "M", "G", "10", "1", "1")])
    assert [str(r.sale_date) for r in src.load_sales(df).collect()] == ["1995-02-15"]
    assert [str(r.sale_date) for r in src.load_sales(df, ["M.d.yyyy"]).collect()] == ["2024-02-15"]


def test_reject_reasons(spark):
    rows = [("S", "03.02.2024", "a", "d", "M", "G", "10", q, s) for q, s in
            [("-0.004", "1"), ("x", "1"), ("1e23", "1"), ("1", "1e30"), ("1", "")]]
    got = [r.reject_reason for r in src.rejection_reasons(_source(spark, rows)).collect()]
    assert got == ["qty_negative", "bad_qty", "qty_too_large", "amount_too_large", None]
    starred = _source(spark, [("*", "03.02.2024", "a", "d", "M", "G", "1", "1", "1"), (None, "03.02.2024", "a", "d", "M", "*", "1", "1", "1"),
                              (None, "03.02.2024", "a", "d", "M", None, "1", "1", "1")])
    assert [r.reject_reason for r in src.rejection_reasons(starred).collect()] == ["reserved_name", "reserved_name", None]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    cols = list(src.REQUIRED_COLUMNS)
    turned = cols[:6] + ["Qty", "Price", "Sum"]
    (tmp_path / "a.csv").write_text(",".join(cols) + "\nS,03.02.2024,a,d,M,G,10,2,20\n" * 5)
    (tmp_path / "b.csv").write_text(",".join(turned) + "\nS,03.02.2024,a,d,M,G,2,10,20\n")
    assert src.load_sales(src.read_sales(spark, str(tmp_path / "b.csv"))).collect()[0].price == 10
    with pytest.raises(Exception, match="(?i)header"):
        src.load_sales(src.read_sales(spark, str(tmp_path))).collect()


def test_large_month_is_split_and_folders_are_pruned(spark, tmp_path):
    import os
    from pyspark.sql import functions as F
    big = spark.range(60_000).select(
        F.lit("S").alias("store"), F.when(F.col("id") % 100 == 0, F.lit("2024-01-05")).otherwise(F.lit("2024-02-05")).cast("date").alias("sale_date"),
        F.uuid().alias("article"), F.uuid().alias("description"), F.lit("m").alias("model"), F.lit("g").alias("segment"),
        F.lit(1.0).alias("price"), F.lit(1).cast(src.MONEY).alias("qty"), F.lit(1).cast(src.MONEY).alias("amount"))
    path = str(tmp_path / "snap")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        src.write_snapshot(big, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (commit,) = os.listdir(f"{path}/data")
    files = lambda m: [f for f in os.listdir(f"{path}/data/{commit}/sale_month={m}") if f.endswith(".parquet")]
    assert len(files("2024-02")) > 3
    january = src.read_snapshot(spark, path, "2024-01-02", "2024-01-31")
    assert january.count() == 600
    assert all("sale_month=2024-01" in f for f in january.inputFiles()) or \
        "sale_month" in january._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_snapshot_roundtrip(spark, make_sales, tmp_path):
    s = make_sales([("S", "2024-01-03", "a", "m", "g", 2.0, 1, 2), ("S", "2024-02-03", "a", "m", "g", 2.0, 3, 6)])
    src.write_snapshot(s, str(tmp_path / "snap"))
    back = src.read_snapshot(spark, str(tmp_path / "snap"))
    assert sorted(r.qty for r in back.collect()) == [1, 3]
    assert back.filter("sale_month = '2024-02'").count() == 1
