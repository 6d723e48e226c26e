"""Refreshing the cube of a grown snapshot: only changed months are read, and results equal a full run."""

import pytest

from shelfcast.operators import monthly as mo
from shelfcast.operators import products as pr
from shelfcast.plans.context import SalesContext
from shelfcast.plans.refresh import read_cube, refresh_cube
from shelfcast.sources import sales as src
from shelfcast.sources import snapshot


@pytest.fixture
def lines(make_sales):
    def build(month, n, qty=1):
        return make_sales([(f"S{i % 2}", f"2024-{month:02d}-{1 + i % 25:02d}", f"a{i % 5}", f"m{i % 3}", "g", 2.0 + i % 4, qty, 2 * qty) for i in range(n)])
    return build


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_as_full(spark, snap, cube):
    full = SalesContext(src.read_snapshot(spark, snap), keep=None)
    fresh = SalesContext(src.read_snapshot(spark, snap), keep=None, facts=read_cube(spark, cube))
    for name in ("daily", "monthly", "trend"):
        assert rows(getattr(fresh, name)) == rows(getattr(full, name)), name
    assert rows(pr.scope_kpis(fresh.facts, fresh.daily)) == rows(pr.scope_kpis(full.facts, full.daily))
    return rows(mo.monthly_summary(fresh.monthly))


def test_only_changed_months_are_combined_anew(spark, tmp_path, lines):
    snap, cube = str(tmp_path / "snap"), str(tmp_path / "cube")
    for m in (1, 2, 3):
        src.write_snapshot(lines(m, 40), snap, append=True)
    assert refresh_cube(spark, snap, cube) == ["2024-01", "2024-02", "2024-03"]
    before = snapshot.manifest(spark, cube)["months"]
    assert refresh_cube(spark, snap, cube) == []
    src.write_snapshot(lines(4, 30), snap, append=True)
    assert refresh_cube(spark, snap, cube) == ["2024-04"]
    after = snapshot.manifest(spark, cube)["months"]
    assert {m: after[m] for m in before} == before
    same_as_full(spark, snap, cube)
    # late lines of an old month
    src.write_snapshot(lines(2, 10, qty=3), snap, append=True)
    assert refresh_cube(spark, snap, cube) == ["2024-02"]
    same_as_full(spark, snap, cube)


def test_the_plan_of_a_refresh_reads_one_month(spark, tmp_path, lines):
    snap = str(tmp_path / "snap")
    for m in (1, 2):
        src.write_snapshot(lines(m, 40), snap, append=True)
    read = snapshot.read(spark, snap, src.SALES_SCHEMA).filter("sale_month IN ('2024-02')")
    assert "PartitionFilters: [isnotnull(sale_month" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 40


def test_replaced_and_compacted_snapshots(spark, tmp_path, lines):
    snap, cube = str(tmp_path / "snap"), str(tmp_path / "cube")
    for m in (1, 2, 2, 3):
        src.write_snapshot(lines(m, 20), snap, append=True)
    refresh_cube(spark, snap, cube)
    assert src.compact_snapshot(spark, snap, fanin=2) > 0
    refresh_cube(spark, snap, cube)
    same_as_full(spark, snap, cube)
    src.write_snapshot(lines(2, 25), snap)  # months 1 and 3 are gone
    assert refresh_cube(spark, snap, cube) == ["2024-01", "2024-02", "2024-03"]
    assert set(snapshot.manifest(spark, cube)["months"]) == {"2024-02"}
    same_as_full(spark, snap, cube)
    snapshot.remove_unlisted(spark, snap, keep_versions=1, min_age_hours=0)
    src.write_snapshot(lines(5, 5), snap)
    snapshot.remove_unlisted(spark, snap, keep_versions=1, min_age_hours=0)  # nobody knows which months the old commit had
    refresh_cube(spark, snap, cube)
    assert set(snapshot.manifest(spark, cube)["months"]) == {"2024-05"}
    same_as_full(spark, snap, cube)


def test_empty_snapshot(spark, tmp_path, lines):
    snap, cube = str(tmp_path / "snap"), str(tmp_path / "cube")
    assert refresh_cube(spark, snap, cube) == [] and read_cube(spark, cube).count() == 0
    src.write_snapshot(lines(1, 3).limit(0), snap)
    assert refresh_cube(spark, snap, cube) == [] and read_cube(spark, cube).count() == 0
