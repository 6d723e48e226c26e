"""Reading, validating and writing the sales table (operators A1-A8).

Source contract: nine columns, named as in the delivered sheet. After
validation every operator works on the canonical schema ``SALES_SCHEMA``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.parse import DATE_LAYOUTS, nan_to_null, parse_day_first_date, parse_number
from shelfcast.operators.scope import ALL
from shelfcast.sources import snapshot

# The nine required source columns, in contract order, and the
# canonical name each one gets.
REQUIRED_COLUMNS = ("Magazin", "Datasales", "Art", "Describe", "Model", "Segment", "Price", "Qty", "Sum")
CANONICAL = {
    "Magazin": "store",
    "Datasales": "sale_date",
    "Art": "article",
    "Describe": "description",
    "Model": "model",
    "Segment": "segment",
    "Price": "price",
    "Qty": "qty",
    "Sum": "amount",
}

# 22 whole digits and 6 decimals: sums of them do not depend on row order.
MONEY = T.DecimalType(28, 6)

SALES_SCHEMA = T.StructType([
    T.StructField("store", T.StringType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("article", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("qty", MONEY),
    T.StructField("amount", MONEY),
])


class MissingColumnsError(ValueError):
    """Raised before any job runs when required source columns are absent."""

    def __init__(self, missing):
        self.missing = list(missing)
        super().__init__(f"missing required columns: {self.missing}")


def read_sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: scan a sales export. CSV is read with every column as text.

    ``enforceSchema`` is off: a file whose header differs from that of the
    others fails the job instead of having its columns bound by position. A
    line with more or fewer cells than the header keeps its text in
    ``BAD_LINE`` (null for other lines) and is rejected by A5.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    header = csv_options(spark.read).csv(path).columns
    return csv_options(spark.read.schema(text_schema(header))).csv(path)


#: Column that holds the text of a line whose cells don't match the header.
BAD_LINE = "_bad_line"


def text_schema(columns: Sequence[str]) -> T.StructType:
    """Every column as text, and the channel for lines that don't fit."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*columns, BAD_LINE)])


def csv_options(reader):
    """Options of a batch or streaming reader for sales exports.

    Cells are counted on whole lines, so the reader doesn't prune columns.
    """
    return (reader.option("header", True).option("inferSchema", False).option("enforceSchema", False)
                  .option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", False))


def require_columns(df: DataFrame) -> DataFrame:
    """A2: fail, naming them, if any of the nine source columns is missing."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing)
    return df


def _date_expr(df: DataFrame, layouts: Sequence[str]):
    dtype = df.schema["Datasales"].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col("Datasales").cast("date")
    return parse_day_first_date(F.col("Datasales").cast("string"), layouts)


def _number_expr(df: DataFrame, name: str):
    if isinstance(df.schema[name].dataType, T.NumericType):
        return nan_to_null(F.col(name).cast("double"))
    return parse_number(F.col(name).cast("string"))


def coerce(df: DataFrame, layouts: Sequence[str] = DATE_LAYOUTS) -> DataFrame:
    """A3 + A4: canonical names and types; unparseable cells become NULL.

    Dates are day-first and kept at day grain (a timestamp's time of day is
    dropped, so intraday rows fall on one day). Quantity and amount become
    DECIMAL(28,6); ``qty_number`` and ``amount_number`` keep what was parsed,
    for rules that look at the value before it is rounded.
    """
    qty, amount = _number_expr(df, "Qty"), _number_expr(df, "Sum")
    parsed = F.struct(
        F.col("Magazin").cast("string").alias("store"),
        _date_expr(df, layouts).alias("sale_date"),
        F.col("Art").cast("string").alias("article"),
        F.col("Describe").cast("string").alias("description"),
        F.col("Model").cast("string").alias("model"),
        F.col("Segment").cast("string").alias("segment"),
        _number_expr(df, "Price").alias("price"),
        qty.try_cast(MONEY).alias("qty"),
        amount.try_cast(MONEY).alias("amount"),
        qty.alias("qty_number"),
        amount.alias("amount_number"),
        (F.col(BAD_LINE).isNotNull() if BAD_LINE in df.columns else F.lit(False)).alias("bad_line"),
    )
    # Parsed once: the filter that follows refers to the generated columns,
    # so Catalyst cannot copy the parse expressions into a pushed-down filter.
    return df.select(F.inline(F.array(parsed)))


# What can become of a source line, in the order in which rules are tried.
OUTCOMES = ("bad_line", "bad_date", "bad_price", "price_not_positive", "bad_qty", "qty_negative",
            "qty_too_large", "amount_too_large", "reserved_name", "accepted")


def reject_reason() -> Column:
    """The first rule a coerced row breaks; NULL when it is accepted (A5).

    Rows need as many cells as the header has, a date, ``price > 0`` and ``qty >= 0`` (before rounding), a
    quantity and amount that fit their type, and a store and segment that aren't
    the name of the roll-up levels.
    """
    return (F.when(F.col("bad_line"), F.lit("bad_line"))
             .when(F.col("sale_date").isNull(), F.lit("bad_date"))
             .when(F.col("price").isNull(), F.lit("bad_price"))
             .when(F.col("price") <= 0, F.lit("price_not_positive"))
             .when(F.col("qty_number").isNull(), F.lit("bad_qty"))
             .when(F.col("qty_number") < 0, F.lit("qty_negative"))
             .when(F.col("qty").isNull(), F.lit("qty_too_large"))
             .when(F.col("amount_number").isNotNull() & F.col("amount").isNull(), F.lit("amount_too_large"))
             .when(F.col("store").eqNullSafe(ALL) | F.col("segment").eqNullSafe(ALL), F.lit("reserved_name")))


def drop_bad_rows(coerced: DataFrame) -> DataFrame:
    """A5: the accepted rows, with the canonical columns."""
    return coerced.filter(reject_reason().isNull()).select(*[f.name for f in SALES_SCHEMA.fields])


def load_sales(df: DataFrame, layouts: Sequence[str] = DATE_LAYOUTS) -> DataFrame:
    """Source frame -> validated canonical sales table (lazy)."""
    return drop_bad_rows(coerce(require_columns(df), layouts))


def rejection_reasons(df: DataFrame, layouts: Sequence[str] = DATE_LAYOUTS) -> DataFrame:
    """Per source row, the first rule it breaks (NULL when accepted)."""
    return coerce(require_columns(df), layouts).withColumn("reject_reason", reject_reason())


def write_snapshot(df: DataFrame, path: str, append: bool = False) -> None:
    """Keep the validated table as the snapshot at ``path``, or add it to what is there.

    Rows are rebalanced by month: a month larger than the advisory partition
    size is split over several tasks and files, small months share a task.
    """
    snapshot.commit(df, path, replace=not append)


def ingest(source: DataFrame, path: str, replace: bool = False, batch: tuple[str, int] | None = None,
           layouts: Sequence[str] = DATE_LAYOUTS) -> bool:
    """A2-A7 in one pass: accepted rows go to the snapshot, and its manifest counts every line by outcome.

    ``batch`` is a stream's name and micro-batch number; a replayed one changes nothing (false).
    """
    seen = Observation()
    outcome = F.coalesce(F.col("reject_reason"), F.lit("accepted"))
    judged = rejection_reasons(source, layouts).observe(seen, *[F.count_if(outcome == o).alias(o) for o in OUTCOMES])
    accepted = judged.filter(F.col("reject_reason").isNull()).select(*[f.name for f in SALES_SCHEMA.fields])
    return snapshot.commit(accepted, path, replace, batch, lambda: {k: n for k, n in seen.get.items() if n})


def reconciliation(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, lines) of every line that ``ingest`` read into the snapshot; their sum is the number of lines."""
    counts = snapshot.outcome_counts(spark, path)
    return spark.createDataFrame([(o, counts[o]) for o in OUTCOMES if o in counts], "outcome string, lines long")


def read_snapshot(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """A7 reader: the canonical table of the snapshot's newest state, whoever wrote it.

    A range of sale dates (ISO text, both ends included) reads only the month
    folders it touches.
    """
    out = snapshot.read(spark, path, SALES_SCHEMA)
    if date_from is not None:
        out = out.filter((F.col("sale_month") >= date_from[:7]) & (F.col("sale_date") >= F.lit(date_from).cast("date")))
    if date_to is not None:
        out = out.filter((F.col("sale_month") <= date_to[:7]) & (F.col("sale_date") <= F.lit(date_to).cast("date")))
    return out.select(*[f.name for f in SALES_SCHEMA.fields])


def compact_snapshot(spark: SparkSession, path: str, **options) -> int:
    """Rewrite many small commits as one (``snapshot.compact``); the number of rewrites."""
    return snapshot.compact(spark, path, SALES_SCHEMA, **options)


def export_forecast_csv(detail: DataFrame, path: str) -> None:
    """The per-day forecast of every scope, with store and segment, as CSV."""
    detail.write.mode("overwrite").option("header", True).csv(path)
