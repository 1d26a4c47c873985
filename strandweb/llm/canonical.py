"""Collapse records that differ only in formatting, and count the copies of each.

Three steps: byte-identical bodies are collapsed first, with counts; only the distinct survivors are parsed and brought to
their canonical text; then the survivors are grouped again on the full canonical text and the counts are summed. Both
groupings combine on the map side, so a body or record that a third of all rows repeat costs one state per map task.

The canonical text of a PageData body: the seven fields in fixed order, whatever their order in the body; of each text
only letters and decimal digits (Unicode), in lower case; ``status`` as a number; ``links`` as a sorted set of such
texts, without empty ones, null like empty. Other fields of the object are ignored, a field that is missing equals null, and a
null text differs from an empty one. Of a repeated field the last value counts, as JSON parsers do.

It is built by Spark's own JSON and text functions, whole-number statuses included. Bodies that their parser takes for broken or
for something else than an object, those with a second closing brace, and those with values of unusual types (nested ones, statuses with fractions,
exponents or as other text), go to :func:`canonical_body`, the same rules in Python: few, unless a source writes nothing else.

Defined cases: a body that is null, empty, broken or no JSON object (trailing text and ``NaN`` included) is no record and comes out
nowhere; deep nesting that the parser refuses counts as broken; texts of any length are taken whole; a number in a place of text is the
text of its spelling; numbers of any length keep all digits.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweb.session import checkpointed

TEXTS = ("url", "lastRunID", "lastUpdatedAt", "foundAt", "contentType")
FIELDS = (*TEXTS, "status", "links")


class _Kept(dict):
    """For ``str.translate``: letters and decimal digits stay, everything else goes. Filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        kind = unicodedata.category(chr(code))
        self[code] = code if kind[0] == "L" or kind == "Nd" else None
        return self[code]


_KEPT = _Kept()


class _Number(str):
    """A JSON number as it is spelt."""


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=lambda name: _refuse(name))
_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]{1,4})?")


def _refuse(name: str) -> None:
    raise ValueError(name)


def canonical_text(value: object) -> str:
    """Letters and decimal digits of a text, in lower case; of another JSON value, those of its JSON text."""
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return text.lower().translate(_KEPT)


def canonical_number(value: object) -> str:
    """A number in one spelling (200, 200.0, 2e2 and "200" agree); anything else as text, marked."""
    if isinstance(value, str) and _NUMBER.fullmatch(value.strip(" ")):
        number = Decimal(value.strip(" "))
        return format(number.normalize() if number else Decimal(0), "f")
    return "~" + canonical_text(value)


def canonical_body(body: str | None) -> str | None:
    """Canonical text of one body, or None if it is no JSON object."""
    if not body:
        return None
    try:
        record = _DECODER.decode(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    parts = []
    for field in FIELDS:
        value = record.get(field)
        if field == "links":
            items = value if isinstance(value, list) else [] if value is None else [value]
            parts.append(" ".join(sorted({canonical_text(x) for x in items if x is not None} - {""})))
        elif value is None:
            parts.append("-")
        else:
            parts.append(canonical_number(value) if field == "status" else canonical_text(value))
    return "|".join(parts)  # neither mark occurs in the parts' texts


@F.pandas_udf(T.StringType())
def canonical_udf(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for body in bodies:
        yield pd.Series([canonical_body(x) for x in body], dtype=object)


_BAD = "_corrupt_record"
_SHAPE = T.StructType([*(T.StructField(f, T.ArrayType(T.StringType()) if f == "links" else T.StringType()) for f in FIELDS), T.StructField(_BAD, T.StringType())])
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


#: Mark the places between texts, between links, and null while all texts are treated at once; bodies that hold them are unusual.
_CUT, _LINK, _NONE = "\u0001", "\u0003", "\u0002"
#: Nested values, and numbers that the parser may spell anew.
_UNUSUAL = rf"(^|[{_CUT}{_LINK}])([\[{{]|-?[0-9]+([.][0-9]|[eE][+-]?[0-9])[0-9eE.+-]*([{_CUT}{_LINK}]|\z))"


def native_text(body: Column, parsed: Column) -> Column:
    """The canonical text of a parsed body, by built-in functions; null where its values need the rules in Python."""
    texts = F.concat_ws(_CUT, *[F.coalesce(parsed[f], F.lit(_NONE)) for f in TEXTS])
    links = F.coalesce(F.array_join(parsed["links"], _LINK), F.lit(""))
    status = parsed["status"]
    usual = parsed[_BAD].isNull() & (status.isNull() | status.rlike(r"^-?[0-9]{1,18}\z")) & ~body.contains("\\u000") & ~texts.rlike(_UNUSUAL) & ~links.rlike(_UNUSUAL)
    kept = lambda x, *marks: F.regexp_replace(F.lower(x), rf"[^\p{{L}}\p{{Nd}}{''.join(marks)}]+", "")
    listed = F.array_join(F.sort_array(F.array_remove(F.array_distinct(F.split(kept(links, _LINK), _LINK)), "")), " ")
    number = F.coalesce(status.try_cast("long").cast("string"), F.lit("-"))
    return F.when(usual, F.concat_ws("|", F.translate(kept(texts, _CUT, _NONE), _CUT + _NONE, "|-"), number, listed))


def canonical_of(df: DataFrame, body: str, name: str) -> DataFrame:
    """``df`` with ``name``, the canonical text of the column ``body``, or null if that is no record."""
    # The parser of from_json stops before text after the object. Where the only closing brace is the end, there is none.
    alone = F.col(body).rlike(r"^\s*\{[^}]*\}\s*\z")
    sure = df.withColumn("__parsed", F.when(alone, F.from_json(F.col(body), _SHAPE, _STRICT)))
    sure = sure.withColumn("__native", F.when(F.col("__parsed").isNotNull(), native_text(F.col(body), F.col("__parsed")))).drop("__parsed")
    rest = canonical_udf(F.when(F.col("__native").isNull(), F.col(body)))
    return sure.withColumn(name, F.coalesce("__native", rest)).drop("__native")


def collapse(df: DataFrame, record: str, body: str) -> tuple[DataFrame, DataFrame]:
    """``(records, spellings)``: ``first, canonical, copies`` for each record; ``body_key, canonical`` for each distinct body.

    ``first`` is the smallest ``record`` id. The survivors are kept in the checkpoint folder, so no body is parsed twice.
    """
    rows = df.select(F.col(record).alias("record"), F.col(body).alias("body")).where(F.col("record").isNotNull() & F.col("body").isNotNull())
    survivors = rows.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("first"))
    survivors = canonical_of(survivors, "body", "canonical").select(F.unhex(F.md5("body")).alias("body_key"), "n", "first", "canonical")
    survivors = checkpointed(survivors).where(F.col("canonical").isNotNull())
    records = survivors.groupBy("canonical").agg(F.min("first").alias("first"), F.sum("n").alias("copies"))
    return records, survivors.select("body_key", "canonical")


def repeats(df: DataFrame, record: str, body: str) -> DataFrame:
    """``(first, record)`` for each row that repeats a record, ``first`` being the record's smallest id.

    The rows find their record by the body's 128-bit digest: one row per digest on the other side, so AQE can split a
    hot body. Bodies without a record drop out.
    """
    records, spellings = collapse(df, record, body)
    firsts = spellings.join(records.where("copies > 1").select("canonical", "first"), "canonical").select("body_key", "first")
    rows = df.select(F.col(record).alias("record"), F.unhex(F.md5(F.col(body))).alias("body_key"))
    return rows.join(firsts, "body_key").where("first < record").select("first", "record").distinct()
