"""Strict typing of JSON rows against the catalog. Rows that don't fit are reported, never bent into shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.catalog import SPARK_TYPES, TableDef, base_type, spark_type

#: What stands for infinite dates and timestamps, which Spark has not; ``<column>__inf`` tells them apart.
LAST, FIRST = dt.datetime(9999, 12, 31), dt.datetime(1, 1, 1)

#: Key of a row's place in its dump.
POSITION = "__pos"

_TEXT = set(SPARK_TYPES[T.StringType()]) - {"json", "jsonb"}
_INTEGER_RANGE = {T.ShortType(): 15, T.IntegerType(): 31, T.LongType(): 63}


def _path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def temporal(text: Column, kind: T.DataType) -> Column:
    """Text to a date or timestamp: RFC 3339 with up to nine decimals, without an offset with T or blank, or a date.

    Years of more than four digits, or before 0, may have the sign that the writer gives them (+12345, -0044).
    A naive timestamp keeps its wall clock when the text has an offset. Infinities become the sentinels; other
    text is null.
    """
    trimmed = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    shaped = trimmed.rlike(r"^[+-]?\d{4,7}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d(:?\d\d)?)?)?$")
    if isinstance(kind, T.TimestampNTZType):
        trimmed = F.regexp_replace(trimmed, r"(?<=\d\d:\d\d:\d\d(\.\d{1,6})?)(Z|[+-]\d\d(:?\d\d)?)$", "")
    value = F.when(shaped, trimmed.try_cast(kind))
    low = F.lower(text)
    return F.when(low.isin("infinity", "+infinity"), F.lit(f"{LAST:%Y-%m-%d}").cast("timestamp_ntz").cast(kind)).when(low == "-infinity", F.lit("0001-01-01").cast("timestamp_ntz").cast(kind)).otherwise(value)


def infinite(text: Column) -> Column:
    """infinity, -infinity or null."""
    low = F.lower(text)
    return F.when(low.isin("infinity", "+infinity"), "infinity").when(low == "-infinity", "-infinity")


def typed(lines: DataFrame, table: TableDef, value: str = "value", infinities: bool = False, longest: int | None = None, writer: dict | None = None) -> DataFrame:
    """JSON lines as typed columns of ``table``, with its place __pos and the array __problems of "column: problem".

    Integers must be integral JSON numbers in range, booleans and texts JSON booleans and strings, dates and
    timestamps strings of a known form; numbers keep all their digits. A column that isn't nullable must be there
    and not null; unknown keys and text that is no JSON object are problems. Missing nullable columns are null.
    With ``infinities`` each date or timestamp column has a column <name>__inf beside it. A line of more than
    ``longest`` bytes is a problem. ``writer`` holds the JSON options that lines were written with: a line that these
    would write again, byte by byte, from its typed values has no problem and needs no look at its single tokens.
    """
    names = [c.name for c in table.columns]
    # from_json tells names by case, fields of a struct don't always.
    again = writer is not None and not infinities and len({n.lower() for n in [*names, POSITION]}) == len(names) + 1 and not any(c.generated for c in table.columns)
    if again:
        schema = T.StructType([*[T.StructField(c.name, spark_type(c.type)) for c in table.columns], T.StructField(POSITION, T.LongType())])
        lines = lines.select(F.col(value).alias("__text"), F.from_json(F.col(value), schema, writer).alias("__row"))
        equal = F.to_json("__row", writer) == F.col("__text")
        for c in table.columns:
            if not c.nullable:
                equal = equal & F.col("__row").getField(c.name).isNotNull()
        if longest is not None:
            equal = equal & (F.octet_length("__text") <= longest)
        lines = lines.select("__text", "__row", F.coalesce(equal, F.lit(False)).alias("__sound"))
        carried = ["__row", "__sound"]
        lines = lines.select(F.when(~F.col("__sound"), F.col("__text")).alias("__value"), *carried)
        value = "__value"
    else:
        carried = []
    # Parsed once; text and JSON type of each column once: these steps are columns of their own.
    lines = lines.select(F.col(value).alias("__value"), F.try_parse_json(F.col(value)).alias("__json"), *carried)
    parts = [x for i, c in enumerate(table.columns) for x in (F.try_variant_get("__json", _path(c.name), "string").alias(f"__text_{i}"), F.schema_of_variant(F.try_variant_get("__json", _path(c.name), "variant")).alias(f"__type_{i}"))]
    lines = lines.select("__value", "__json", *carried, *parts, F.coalesce(F.schema_of_variant("__json").startswith("OBJECT<"), F.lit(False)).alias("__object"))
    object_ = F.col("__object")
    judged, out, problems = [], [], [F.when(~object_, F.lit("*: not a JSON object"))]
    if longest is not None:
        problems.append(F.when(F.octet_length("__value") > longest, F.lit(f"*: more than {longest} bytes")))
    for i, c in enumerate(table.columns):
        kind, name = spark_type(c.type), base_type(c.type)
        text, json_type = F.col(f"__text_{i}"), F.col(f"__type_{i}")
        there = text.isNotNull()
        number = json_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
        if kind in _INTEGER_RANGE:
            exact = text.try_cast(T.DecimalType(38, 10))
            fits = number & (exact == F.floor(exact)) & (F.abs(exact + F.lit(0.5).cast("decimal(2,1)")) < F.lit(str(2 ** _INTEGER_RANGE[kind])).cast("decimal(20,0)"))
            cast, bad = exact.try_cast(kind), there & ~F.coalesce(fits, F.lit(False))
        elif isinstance(kind, T.BooleanType):
            cast, bad = text.try_cast(kind), there & (json_type != "BOOLEAN")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cast = temporal(text, kind)
            bad = there & ((json_type != "STRING") | cast.isNull())
            if infinities:
                judged.append(infinite(text).alias(f"{c.name}__inf"))
                out.append(F.col(f"{c.name}__inf"))
        elif isinstance(kind, T.BinaryType):
            cast = F.try_to_binary(text, F.lit("base64"))
            bad = there & ((json_type != "STRING") | cast.isNull())
        elif isinstance(kind, T.StringType):
            # Types of other kinds (json, arrays, ranges) are carried as they are.
            cast, bad = text, there & (json_type != "STRING") if name in _TEXT else F.lit(False)
        else:  # numeric, real and double precision
            cast = text.try_cast(kind)
            bad = there & cast.isNull()
        judged += [cast.alias(f"__cast_{i}"), F.coalesce(bad, F.lit(False)).alias(f"__bad_{i}"), there.alias(f"__there_{i}")]
        out.append(F.when(~F.col(f"__bad_{i}"), F.col(f"__cast_{i}")).alias(c.name))
        problems.append(F.when(object_ & F.col(f"__bad_{i}"), F.lit(f"{c.name}: no {c.type}")))
        if not c.nullable and c.generated is None:
            problems.append(F.when(object_ & ~F.col(f"__there_{i}"), F.lit(f"{c.name}: missing or null")))
    known = F.array(*[F.lit(n) for n in [*(c.name for c in table.columns), POSITION]])
    unknown = F.array_except(F.coalesce(F.json_object_keys("__value"), F.array().cast("array<string>")), known)
    found = F.concat(F.array_compact(F.array(*problems)), F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown key"))))
    place = F.try_variant_get("__json", _path(POSITION), "bigint").alias(POSITION)
    lines = lines.select("__value", "__json", "__object", *carried, *judged)
    if again:
        row, fine = F.col("__row"), F.col("__sound")
        out = [F.when(fine, row.getField(n)).otherwise(o).alias(n) for n, o in zip(names, out, strict=True)]
        place = F.when(fine, row.getField(POSITION)).otherwise(place).alias(POSITION)
        found = F.when(fine, F.array().cast("array<string>")).otherwise(found)
    return lines.select(*out, place, found.alias("__problems"))


def violations(rows: DataFrame) -> DataFrame:
    """One row (__pos, problem) per problem of rows made by :func:`typed`."""
    # Of a plain column, Spark infers a filter on its size, which would be moved below the parsing steps and repeat them
    # for each column they look at; of an expression it infers none.
    return rows.select(POSITION, F.explode(F.array_compact("__problems")).alias("problem"))


def sound(rows: DataFrame) -> DataFrame:
    """The rows made by :func:`typed` that have no problem, without __problems; each is parsed once, which a filter would undo."""
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "__problems"])
    return rows.select(F.inline(F.when(F.size("__problems") == 0, F.array(kept))))
