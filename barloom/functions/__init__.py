"""Scalar functions as Columns: numbers as reports write them, dates, calendars, text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: texts that mean a missing number
MISSING = ["--", "n/a", "不适用", "nan", "none", "-", ""]


def parse_number(text: Column) -> Column:
    """A number written with 亿 (1e8, looked for first) or 万 (1e4), commas and blanks; null where there is none."""
    t = F.trim(text)
    scale = F.when(t.contains("亿"), 1e8).when(t.contains("万"), 1e4).otherwise(1.0)
    value = F.regexp_replace(t, "[亿万, ]", "").try_cast("double")
    return F.when(~F.lower(t).isin(MISSING), finite(value) * scale)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rounded(x: Column, places: int) -> Column:
    """x times a power of ten, rounded half away from zero, and divided again, as SQL engines on doubles do; F.round goes by the decimal text of x."""
    return signed_round(x * 10.0**places, 0) / 10.0**places


def signed_round(x: Column, places: int) -> Column:
    """F.round of a double, but what rounds to zero keeps its sign, as in SQL on doubles: F.round goes by decimals, which have no -0.0."""
    near = F.round(x, places)
    return F.when(near == 0, x * 0.0).otherwise(near)


def exact_sum(x: Column) -> Column:
    """Sum of doubles by decimals of 8 places, so it does not depend on the order in which rows come; values that no such decimal holds are added as doubles."""
    exact = x.try_cast("decimal(28,8)")
    total, rest = F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), x))
    return F.coalesce(total + rest, total, rest)


def lookup_number(data: Column, name: str) -> Column:
    """A JSON object's number under a key: the key itself, else the first other key that holds the name and parses."""
    entries = F.map_entries(F.from_json(data, "map<string,string>"))
    own = F.try_element_at(F.transform(F.filter(entries, lambda e: e["key"] == F.lit(name)), lambda e: parse_number(e["value"])), F.lit(1))
    near = F.filter(F.transform(F.filter(entries, lambda e: (e["key"] != F.lit(name)) & e["key"].contains(name)), lambda e: parse_number(e["value"])), lambda v: v.isNotNull())
    return F.coalesce(own, F.try_element_at(near, F.lit(1)))


def large_number(x: Column) -> Column:
    """x.xx亿 or x.xx万 by size; empty for null."""
    return F.when(x.isNull(), "").when(F.abs(x) >= 1e8, F.format_string("%.2f亿", rounded(x / 1e8, 2))).when(F.abs(x) >= 1e4, F.format_string("%.2f万", rounded(x / 1e4, 2))).otherwise(F.format_string("%.2f", rounded(x, 2)))


def yes_no(x: Column) -> Column:
    return F.when(x.isNull(), "不适用").when(x, "是").otherwise("否")


def mixed_date(text: Column) -> Column:
    """A date from YYYY-MM-DD[ HH:MM:SS], YYYYMMDD or YYYY年MM月DD日; null for other texts."""
    t = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(t, "[年月]", "-"), "日", "")
    compact = F.concat_ws("-", t.substr(1, 4), t.substr(5, 2), t.substr(7, 2))
    return F.when(t.rlike(r"^\d{8}$"), compact.try_cast("date")).when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( |$)"), F.split_part(plain, F.lit(" "), F.lit(1)).try_cast("date"))


def document_url(page: Column, host: str) -> Column:
    """host/date/id.PDF from a page address with announcementId and announcementTime; null without them or with a time that is no date."""
    parameter = lambda name: F.nullif(F.parse_url(page, F.lit("QUERY"), F.lit(name)), F.lit(""))
    day = F.split_part(F.regexp_replace(parameter("announcementTime"), "%20|[+]", " "), F.lit(" "), F.lit(1)).try_cast("date")
    return F.concat(F.lit(host + "/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/"), parameter("announcementId"), F.lit(".PDF"))


def week_friday(date: Column) -> Column:
    """The Friday that closes a date's week from Saturday to Friday."""
    return F.next_day(F.date_sub(date, 1), "FR")


def business_month_end(date: Column) -> Column:
    """The last business day of the date's month, or of the next month for a weekend after it."""

    def end(d: Column) -> Column:
        last = F.last_day(d)
        return F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4))

    return F.when(date > end(date), end(F.add_months(F.trunc(date, "month"), 1))).otherwise(end(date))


def exchange_suffix(code: Column, with_two: bool = True) -> Column:
    """code.SH for 6, code.SZ for 0, 3 (and 2), code.BJ for 8 and 4, else null."""
    first = code.substr(1, 1)
    return F.when(first == "6", F.concat(code, F.lit(".SH"))).when(first.isin(["0", "3", "2"] if with_two else ["0", "3"]), F.concat(code, F.lit(".SZ"))).when(first.isin("8", "4"), F.concat(code, F.lit(".BJ")))


def analysis_date(moment: Column) -> Column:
    """The last day to analyse: Friday on weekends; before 16:00 the business day before."""
    day, weekday = F.to_date(moment), F.weekday(moment)
    return (
        F.when(weekday == 5, F.date_sub(day, 1)).when(weekday == 6, F.date_sub(day, 2))
        .when(F.hour(moment) >= 16, day).when(weekday == 0, F.date_sub(day, 3)).otherwise(F.date_sub(day, 1))
    )


def numeral(text: Column) -> Column:
    """The number of the first of the numerals 一 to 十 in a text."""
    found = F.regexp_extract(text, "([一二三四五六七八九十])", 1)
    return F.nullif(F.array_position(F.split(F.lit("一,二,三,四,五,六,七,八,九,十"), ","), found), F.lit(0))


def normalise_space(text: Column) -> Column:
    """Blank lines and blanks around newlines go, runs of blanks become one, both ends are trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s*\n\s*", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def drop_repeated_lines(text: Column, least: int = 3, longest: int | None = 100) -> Column:
    """Lines that occur at least ``least`` times (trimmed, not empty, not longer than ``longest``) go everywhere.

    One aggregation of the sorted lines finds them, so a text of n lines costs n log n.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(F.array_sort(lines), lambda x: (F.length(x) > 0) & ((F.length(x) <= longest) if longest else F.lit(True)))
    repeated = F.element_at(F.transform(F.array(kept), lambda s: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - least + 1)), lambda i: F.when(F.get(s, i - 1) == F.get(s, i + least - 2), F.get(s, i - 1))), lambda x: x.isNotNull()))), 1)
    return F.element_at(F.transform(F.array(repeated), lambda r: F.when(F.size(r) == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(r, F.trim(x))), "\n"))), 1)
