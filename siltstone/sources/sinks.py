"""Sinks for result tables: separated values, JSON objects and JSON rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame) -> DataFrame:
    """Text columns with spaces for tabs, trimmed."""
    return df.select([F.trim(F.replace(F.col(c), F.lit("\t"), F.lit(" "))).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def xsv_row(df: DataFrame, sep: str = ",") -> Column:
    """A line of quoted values, quotes doubled."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(sep, *[cell(c) for c in df.columns])


def write_xsv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    tidy(df).fillna("").write.option("quoteAll", True).option("escape", '"').option("sep", sep).option("header", header).option("emptyValue", "").csv(path)


def json_object(df: DataFrame) -> Column:
    """A JSON object of the cells that hold something; keys lose case, spaces and dashes."""
    key = lambda c: c.lower().replace(" ", "").replace("-", "")
    full = lambda c, t: F.nullif(F.col(c), F.lit("")) if t == "string" else F.col(c)
    return F.to_json(F.struct(*[full(c, t).alias(key(c)) for c, t in df.dtypes]))


def json_row(df: DataFrame) -> Column:
    """A JSON array of all cells as text."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))


def link_cell(url: Column, formula: str = "HYPERLINK") -> Column:
    """A quoted cell with a spreadsheet formula that links to ``url``; an empty cell for no URL."""
    return F.when(url != "", F.concat(F.lit(f'"={formula}(""'), url, F.lit('"";""\U0001f53d"")"'))).otherwise(F.lit('""'))


def json_list(df: DataFrame, folder: str, header: bool = False) -> DataFrame:
    """Lines of one JSON array of objects, or of arrays with the names in front where there is a ``header``; lines are numbered
    by position, so that they can be written in order. The numbered rows are written in ``folder`` first, so that the line
    that begins the array is the same however often they are read."""
    row = json_row(df) if header else json_object(df)
    rows = tidy(df).select(F.monotonically_increasing_id().alias("n"), row.alias("value")).filter("value <> '{}'")
    place = f"{folder}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(place)
    rows = df.sparkSession.read.schema(rows.schema).parquet(place)
    first = rows.agg(F.min("n")).first()[0]
    head = json.dumps(df.columns, ensure_ascii=False) if header else ""
    mark = F.when((F.col("n") == F.lit(first)) & F.lit(not header), "[").otherwise(",")
    edges = [(-1, "[" + head)] if header or first is None else []
    lines = rows.select("n", F.concat(mark, "value").alias("value"))
    return lines.unionByName(df.sparkSession.createDataFrame([*edges, (1 << 62, "]")], "n long, value string"))


def write_json_list(df: DataFrame, path: str, folder: str, header: bool = False) -> None:
    """One JSON array as text; its parts, taken in order of their names, are the whole."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    json_list(df, folder, header).repartitionByRange(parts, "n").sortWithinPartitions("n").select("value").write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line."""
    tidy(df).select(json_object(df).alias("value")).write.text(path)


def as_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns of several lines as lists."""
    return df.withColumns({c: F.split(F.col(c), "\n") for c in columns})
