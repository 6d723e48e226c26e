"""Refreshing the fact cube of a grown snapshot (D2, D6, H1 and all that is read from the cube).

The cube is additive and kept by sale month. A refresh compares the snapshot's
commits with those that the cube was made of; the months of commits that came
or went are combined anew, all others are kept as they are. What a refresh
writes goes to a folder of its own and counts once the cube's manifest lists
it, so readers never see a half-written month, and a refresh that fails leaves
the cube as it was.

    refresh_cube(spark, snapshot, cube)
    c = SalesContext(read_snapshot(spark, snapshot), facts=read_cube(spark, cube))
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators.cube import fact_cube
from shelfcast.sources import snapshot
from shelfcast.sources.sales import SALES_SCHEMA


def _months(spark: SparkSession, path: str, folder: str) -> set[str]:
    return {n.partition("=")[2] for n in snapshot.names(spark, path, folder) if n.startswith("sale_month=")}


def refresh_cube(spark: SparkSession, snapshot_path: str, cube_path: str) -> list[str]:
    """Bring the cube at ``cube_path`` up to the snapshot's newest state; the months that were combined anew.

    Nothing is read where no commit came or went. If a commit that went is no
    longer there to say which months it had, all months are combined anew.
    """
    now = snapshot.manifest(spark, snapshot_path)
    old = snapshot.manifest(spark, cube_path)
    listed, seen = {c["name"] for c in now["commits"]}, set(old.get("seen", []))
    if listed == seen:
        return []
    found = {n: _months(spark, snapshot_path, f"data/commit={n}") for n in listed | seen}
    # a commit without rows has no month either
    gone = any(not found[n] and n not in listed for n in seen)
    differing = listed | seen if gone else listed ^ seen
    changed = sorted(set().union(*[found[n] for n in differing], old.get("months", {}) if gone else ()))
    made = uuid.uuid4().hex
    if changed:
        rows = snapshot.read(spark, snapshot_path, SALES_SCHEMA, [c["name"] for c in now["commits"] if c["bytes"]])
        (fact_cube(rows.filter(F.col("sale_month").isin(changed)))
         .withColumn("sale_month", F.date_format("ds", "yyyy-MM")).hint("rebalance", "sale_month")
         .write.mode("overwrite").partitionBy("sale_month").parquet(f"{cube_path}/data/refresh={made}"))
    written = _months(spark, cube_path, f"data/refresh={made}")

    def publish(state: dict) -> dict | None:
        if state["version"] != old["version"]:
            raise RuntimeError("the cube was refreshed by another job at the same time")
        kept = {m: r for m, r in state.get("months", {}).items() if m not in changed}
        return {"commits": [], "streams": {}, "seen": sorted(listed), "months": {**kept, **{m: made for m in written}}}
    snapshot.publish(spark, cube_path, publish)
    return changed


def read_cube(spark: SparkSession, cube_path: str) -> DataFrame:
    """The fact cube as last refreshed (``operators.cube.fact_cube``)."""
    months = snapshot.manifest(spark, cube_path).get("months", {})
    empty = fact_cube(spark.createDataFrame([], SALES_SCHEMA))
    if not months:
        return empty
    schema = T.StructType([*empty.schema.fields, T.StructField("refresh", T.StringType()), T.StructField("sale_month", T.StringType())])
    return (spark.read.schema(schema).option("basePath", f"{cube_path}/data")
            .parquet(*[f"{cube_path}/data/refresh={r}/sale_month={m}" for m, r in sorted(months.items())])
            .drop("refresh", "sale_month"))
