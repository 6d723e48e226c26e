from pyspark.sql import functions as F

from shelfcast.functions.joins import salted_join
from shelfcast.operators.topn import top_n


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("*")).otherwise((F.col("id") % 7).cast("string")).alias("store"),
        F.lit("g").alias("segment"), F.col("id"))
    small = spark.createDataFrame([("*", "g", 100)] + [(str(i), "g", i) for i in range(6)],
                                  "store string, segment string, v int")
    plain = big.join(small, ["store", "segment"])
    assert _sorted(salted_join(big, small, ["store", "segment"])) == _sorted(plain)
    assert _sorted(salted_join(big, small, ["store", "segment"], "left", buckets=5)) == \
        _sorted(big.join(small, ["store", "segment"], "left"))


def test_top_n_exact_under_one_hot_group(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 20000).alias("v"))
    got = top_n(df, ["g"], [F.col("v").desc()], 5, buckets=8).select("g", "v", "rank")
    want = [(g, 19999 - 2 * k - (1 - g), k + 1) for g in (0, 1) for k in range(5)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
