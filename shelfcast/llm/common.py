"""Helpers shared by the training-data operators: shared storage, reading, per-worker caches."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls 9-13.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a scratch folder; a cluster session
    is refused, since a machine-local folder would not be shared there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shelfcast-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Blocks of ``intermediates`` that are open, with the runs begun inside.
_OPEN: list[list[Shared]] = []


@contextlib.contextmanager
def intermediates():
    """Delete, at the end of the block, all tables that operators called inside it have written.

        with intermediates():
            near_duplicates(docs).write.parquet(where)
    """
    held: list[Shared] = []
    _OPEN.append(held)
    try:
        yield
    finally:
        _OPEN.remove(held)
        for run in held:
            run.drop("")


class Shared:
    """Intermediate tables of one run, written as Parquet under the shared folder.

    A written table cuts lineage: it survives lost executors, and whatever reads
    it does not repeat the work above it. Each run has its own folder. Tables
    that a result reads stay until the caller has stored that result and leaves
    ``intermediates``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/shelfcast-llm/{name}-{uuid.uuid4().hex}"
        self._written: set[str] = set()
        for held in _OPEN:
            held.append(self)

    def tables(self) -> list[str]:
        """Tables written and not removed."""
        return sorted(self._written)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        where = f"{self.path}/{table}"
        self._written.add(table)
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *tables: str) -> None:
        """Remove tables that no later step reads (the empty name: the run's folder)."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for table in tables:
            self._written.discard(table)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)

    def free(self) -> None:
        """Let Spark delete the shuffle files of jobs whose results are written.

        They go when the driver's JVM collects the plans that made them, which
        could otherwise be long after the last step has read them.
        """
        gc.collect()
        self.spark._jvm.System.gc()


def per_worker(key, build):
    """``build()`` once per Python worker process; workers are reused between tasks."""
    cache = sys.modules.setdefault("_shelfcast_llm_cache", types.ModuleType("_shelfcast_llm_cache")).__dict__
    if key not in cache:
        cache[key] = build()
    return cache[key]


def batches_of(schema: pa.Schema, rows, limit_bytes: int = 8 << 20, limit_rows: int = 4096):
    """Arrow batches from an iterator of tuples, cut by rows and by bytes of the binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if len(held) >= limit_rows or size >= limit_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_rows(df: DataFrame, make_rows, schema: pa.Schema, slice_rows: int = 256) -> DataFrame:
    """``mapInArrow`` with a generator: ``make_rows(iterator of row tuples)`` yields result tuples.

    ``slice_rows`` rows are Python objects at a time; results go out in bounded Arrow batches.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        def rows():
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for at in range(0, batch.num_rows, slice_rows):
                    yield from zip(*(c.slice(at, slice_rows).to_pylist() for c in columns))
        yield from batches_of(schema, make_rows(rows()))

    return df.mapInArrow(run, from_arrow_schema(schema))


def may_contain(keys: DataFrame, key: str, column, bits: int = 1 << 24):
    """Condition that holds wherever ``column`` is among ``keys[key]``, and seldom elsewhere.

    A bitmap of hashes of a fixed size (2 MB) is broadcast, however many keys there
    are; the more there are, the more other rows it lets through. It thins out
    a large table before an exact join.
    """
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))
    words = (keys.select(place(F.col(key)).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS INT))")).alias("set")))
    found = words.collect()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[[r["word"] for r in found]] = [r["set"] for r in found]
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
    return F.pandas_udf(test, "boolean")(place(column))


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the decimal doc_id leaves ``remainder``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))
