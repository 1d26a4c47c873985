"""Messages as JSON text: decoding that skips malformed ones, and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweb.schemas import PAGE_JSON, RUN, TASK

_BAD = "_corrupt_record"


def _zero(column: Column, kind: T.DataType) -> Column:
    """With missing scalars as zero values; nested optional structs stay null."""
    if isinstance(kind, T.StructType):
        return column
    zero = {T.StringType: "", T.IntegerType: 0, T.BooleanType: False}.get(type(kind))
    return column if zero is None else F.coalesce(column, F.lit(zero))


def _decoded(messages: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    """``messages`` with ``m``, the parsed message. A null, a syntax error or a field of the wrong type drops the message; Spark
    makes a struct of nulls of such ones, so the corrupt-record field decides, not the nulls."""
    marked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    text = F.col(value).cast("string")
    parsed = messages.withColumn("m", F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false"}))
    return parsed.where(F.col("m").isNotNull() & F.col(f"m.{_BAD}").isNull() & text.rlike(r"^\s*\{"))


def decode_runs(messages: DataFrame, value: str = "value") -> DataFrame:
    return _decoded(messages, value, RUN).select(*[_zero(F.col(f"m.{f.name}"), f.dataType).alias(f.name) for f in RUN])


def decode_tasks(messages: DataFrame, value: str = "value") -> DataFrame:
    """``url, current_depth, run``; a task without run has one of zero values."""
    own = _decoded(messages, value, TASK)
    run = F.struct(*[_zero(F.col(f"m.run.{f.name}"), f.dataType).alias(f.name) for f in RUN])
    return own.select(F.coalesce("m.url", F.lit("")).alias("url"), F.coalesce("m.current_depth", F.lit(0)).alias("current_depth"), run.alias("run"))


def encode(df: DataFrame, *columns: str) -> DataFrame:
    """``value``: the JSON text of each row (of ``columns``, or all). Null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in columns or df.columns])).alias("value"))


def encode_pages(pages: DataFrame) -> DataFrame:
    """``value``: pages under their wire names."""
    return pages.select(F.to_json(F.struct(*[F.col(c).alias(wire) for c, wire in PAGE_JSON.items()])).alias("value"))
