"""Lines to tokens and back: delimited, JSON and space-separated forms; validation of strengths."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StringType()))
def _csv_with_escapes(lines: pd.Series) -> pd.Series:
    """RFC 4180 quoting together with backslash escapes, which no built-in reader has."""
    return pd.Series([next(csv.reader([x], doublequote=True, escapechar="\\"), [""]) if x else [""] for x in lines])


def parse_lines(lines: DataFrame, column: str = "value", out: str = "tokens") -> DataFrame:
    """Add the tokens of each line: a JSON array if it is in square brackets, else delimited by commas.

    Lines without quotes and backslashes are split by a built-in; only the others visit Python, so the frame is cut
    into two scans that are joined by a union.  A malformed JSON array fails the query, as does a line that can't be
    read in batch layers.
    """
    line = F.col(column)
    is_json = line.startswith("[") & line.endswith("]")
    quoted = ~is_json & (line.contains('"') | line.contains("\\"))
    plain = lines.where(~quoted | line.isNull()).withColumn(out, F.when(is_json, json_tokens(line)).otherwise(F.split(line, ",", -1)))
    odd = lines.where(quoted).withColumn(out, _csv_with_escapes(line))
    return plain.unionByName(odd)


def json_tokens(line: Column) -> Column:
    """Scalars of a JSON array as strings; an error for what is no array."""
    return F.from_json(line, "array<string>", {"mode": "FAILFAST"})


def split_delimited(line: Column, delimiter: str = ",") -> Column:
    return F.split(line, "[" + delimiter + "]", -1)


def split_pmml(line: Column) -> Column:
    """Space-separated values, runs of spaces counting once; quoted values keep their spaces."""
    found = F.regexp_extract_all(line, F.lit(r'("(?:[^"\\]|\\.)*"|[^ ]+)'), F.lit(1))
    unquote = lambda t: F.when(t.startswith('"') & (F.length(t) > 1), F.regexp_replace(t.substr(F.lit(2), F.length(t) - 2), r'\\"', '"')).otherwise(t)
    return F.transform(F.filter(found, lambda t: t != ""), unquote)


def join_delimited(values: Column) -> Column:
    """Comma-joined values; those with commas, quotes, backslashes or line ends are quoted."""
    escape = lambda v: F.when(v.rlike(r'[",\\\r\n]'), F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', '""'), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(values, escape), ",")


def join_pmml(values: Column) -> Column:
    """Space-joined values; quotes are escaped, and values with spaces or quotes stand in quotes."""
    escape = lambda v: F.when(v.rlike(r'[" ]') | (v == ""), F.concat(F.lit('"'), F.regexp_replace(v, '"', r'\\"'), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(values, escape), " ")


def to_json_array(*columns: Column) -> Column:
    """A JSON array of columns of any types, as the wire formats have it."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2) for c in columns]), F.lit("]"))


def standard_strength(token: Column) -> Column:
    """Empty stays empty (a delete); a finite number is written as a float; anything else is null."""
    number = token.try_cast("float")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(F.trim(token) == "", F.lit("")).when(finite, number.cast("string"))


def ingest(tokens: Column, now_ms: Column) -> Column:
    """user,item,strength,timestamp lines for the input log, null for lines that must be rejected.

    Two tokens at least; a missing strength is 1; a missing timestamp is now; timestamps are positive.
    """
    n = F.size(tokens)
    strength = F.when(n >= 3, standard_strength(F.get(tokens, 2))).otherwise(F.lit("1"))
    stamp = F.when(n >= 4, F.get(tokens, 3).try_cast("bigint")).otherwise(now_ms)
    ok = (n >= 2) & strength.isNotNull() & (stamp > 0)
    return F.when(ok, join_delimited(F.array(F.get(tokens, 0), F.get(tokens, 1), strength, stamp.cast("string"))))


def item_weights(path: Column) -> Column:
    """``item`` or ``item=weight`` elements as an array of (item, weight), 1.0 by default."""
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.struct(F.get(F.split(p, "=", 2), 0).alias("item"), F.coalesce(F.get(F.split(p, "=", 2), 1).cast("double"), F.lit(1.0)).alias("weight")))


def words(line: Column) -> Column:
    """Tokens between single spaces; empty ones count except at the end."""
    return F.split(F.rtrim(line), " ")


def csv_rows(values: list[list[str]]) -> str:
    """Rows of a small response as CSV text, on the driver."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(values)
    return out.getvalue()
