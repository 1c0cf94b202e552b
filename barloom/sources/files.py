"""Loads of files and vendors' tables: CSV with thousands separators, field by time matrices, localised headers, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import functions as fn

#: fixed values: headers of a vendor's daily table
HEADERS = {
    "日期": "date", "股票代码": "symbol", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "pct_change", "涨跌额": "price_change", "换手率": "turnover",
}
#: fixed values: texts of a sheet that mean a missing value
BLANKS = ["none", "nan", "-", "--", ""]


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV file with a header as the named columns and types; numbers may hold thousands separators, what does not parse is null."""
    text = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)
    return text.select(*[F.col(c) if kind == "string" else F.regexp_replace(F.trim(c), ",", "").try_cast(kind).alias(c) for c, kind in columns.items()])


def from_matrix(vendor: DataFrame, columns: dict[str, str]) -> DataFrame:
    """symbol, date and one number a column from rows (code, fields, times, data): data has an array a field, a value a time.

    Fields are found by their lower-case names, whatever their order; a code loses its exchange suffix, volumes become lots
    of 100, and values that are no finite numbers are null.
    """
    each = vendor.select(F.split_part("code", F.lit("."), F.lit(1)).alias("symbol"), F.transform("fields", F.lower).alias("fields"), "data", F.posexplode("times").alias("i", "date"))

    def value(field: str):
        at = F.nullif(F.array_position("fields", field), F.lit(0)).cast("int")
        x = fn.finite(F.get(F.get(F.col("data"), at - 1), F.col("i")).try_cast("double"))
        return x / 100 if field == "volume" else x

    return each.select("symbol", F.col("date").cast("date").alias("date"), *[value(k).alias(c) for k, c in columns.items()])


def from_headers(table: DataFrame, headers: dict[str, str] = HEADERS) -> DataFrame:
    """The columns of a table under their own names, in the order of the map; others go, missing ones are null numbers."""
    have = set(table.columns)
    typed = {"date": "date", "symbol": "string"}
    out = [(F.col(f"`{k}`") if k in have else F.lit(None)).cast(typed.get(c, "double")).alias(c) for k, c in headers.items()]
    return table.select(*out)


def from_sheet(sheet: DataFrame, items: dict[str, tuple[str, str]]) -> DataFrame:
    """One typed record a symbol from rows (symbol, item, value): items maps an item to (column, long, double, date or string)."""
    value = F.trim("value")
    clean = sheet.select("symbol", "item", F.when(~F.lower(value).isin(BLANKS), value).alias("value"))
    wide = clean.groupBy("symbol").pivot("item", list(items)).agg(F.first("value", ignorenulls=True))

    def typed(item: str, kind: str):
        x = F.col(f"`{item}`")
        if kind == "string":
            return x
        if kind == "date":
            return fn.mixed_date(x)
        number = fn.finite(F.regexp_replace(x, ",", "").try_cast("double"))
        return number.cast("long") if kind == "long" else number

    return wide.select("symbol", *[typed(item, kind).alias(c) for item, (c, kind) in items.items()])
