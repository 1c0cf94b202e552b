"""Document cleaning as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: fixed values: flags for Unicode classes and newline-only line ends; numerals; headings that are never table lines
FLAGS = "(?dmU)"
NUMERALS = "一二三四五六七八九十"
HEADING = rf"^([（(]\s*[{NUMERALS}\d]+\s*[）)]|[①-⑩]|[{NUMERALS}\d]+[.、．]|■|●|◆)"


def strip(text: Column) -> Column:
    """text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def titles(name: str) -> list[str]:
    """Patterns of a line with a section's title: alone, with marks after it, after a chapter or section number."""
    word = "\\Q" + name + "\\E"
    return [rf"^\s*{word}\s*$", rf"^\s*{word}[^\w\n]*$", rf"^\s*(?:第\s*[{NUMERALS}]+\s*[节章]|\d{{1,2}}(?:\.\d{{1,2}})?\s*[.、]?)\s*{word}[^\w\n]*$"]


def section(text: Column, starts: list[str], ends: list[str]) -> Column:
    """What follows the first of the patterns that matches, up to the nearest line that begins with an end marker, or to the end.

    Lines of dotted leaders with a page and lines of a page number go; null where no pattern matches or nothing is left.
    """
    starts = [F.lit(FLAGS + x) for x in starts]
    after = reduce(F.coalesce, [F.when(F.regexp_instr(text, x) > 0, F.regexp_instr(text, x) + F.length(F.regexp_substr(text, x))) for x in starts])
    body = F.substring(text, after, F.length(text))
    stops = [F.nullif(F.regexp_instr(body, F.lit(rf"{FLAGS}^\s*\Q{e}\E")), F.lit(0)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0]
    kept = strip(F.when(stop.isNull(), body).otherwise(F.substring(body, F.lit(1), stop - 1)))
    clean = F.regexp_replace(F.regexp_replace(kept, FLAGS + r"^[^\n]*\.{3,}\s*\d+\s*$", ""), FLAGS + r"^\s*\d+\s*$", "")
    return F.nullif(F.regexp_replace(clean, r"\n{3,}", "\n\n"), F.lit(""))


def without_tables(text: Column) -> Column:
    """Lines of prose: blank ones, those that end in 。 and headings stay; others go where they are short or hold little
    Chinese with a gap of three blanks, or hold three digits, points or commas with at most brackets, signs and blanks between."""
    number = r"(?U)[\d,.](?:\)?%?\s*\(?-?[\d,.]){2}"

    def stays(line: Column) -> Column:
        bare, wide = strip(line), line.rlike(r"(?U)\s{3,}")
        prose = (bare == "") | bare.endswith("。") | bare.rlike("(?U)" + HEADING)
        table = (wide & (F.length(bare) < 15)) | bare.rlike(number) | (wide & (F.length(F.regexp_replace(bare, r"[^一-龥]", "")) < 10))
        return prose | ~table

    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"), r"\n{3,}", "\n\n")


def paragraphs(text: Column) -> Column:
    """Soft-wrapped lines joined: a paragraph ends with a line that ends in a mark or a digit, or that is the text's last; blank lines go."""
    lines = F.split(text, "\n")

    def line(x: Column, i: Column) -> Column:
        bare = strip(x)
        ends = bare.rlike(r'(?U)[。！？"：;)\]\d]$') | (i == F.size(lines) - 1)
        return F.when(bare == "", "").when(ends, F.concat(bare, F.lit("\n"))).otherwise(bare)

    return F.array_join(F.transform(lines, line), "")


def narrative(text: Column, name: str, ends: list[str]) -> Column:
    """The paragraphs of one section without its tables."""
    return paragraphs(without_tables(section(text, titles(name), ends)))


def _pairs(blocks: Column, question, answer) -> Column:
    pairs = F.transform(blocks, lambda x: F.struct(question(x).alias("question"), answer(x).alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def questions(text: Column) -> Column:
    """array<struct<question, answer>> of a text with Q: and A: before them; what lies before the first Q: goes."""
    blocks = F.filter(F.slice(F.split(text, "Q:"), 2, F.greatest(F.lit(1), F.size(F.split(text, "Q:")))), lambda x: x.contains("A:"))
    return _pairs(blocks, lambda x: strip(F.substring_index(x, "A:", 1)), lambda x: strip(F.regexp_replace(x, "(?s)^.*?A:", "")))


def numbered_questions(text: Column) -> Column:
    """array<struct<question, answer>> of a text with numbers (1. or 1、) before questions, the answer on the lines after, maybe after 答:."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(r"(?sU)(\d+[.、．]\s*.*?)(?=\d+[.、．]|$)"), F.lit(1)), strip)
    first = lambda x: F.substring_index(x, "\n", 1)
    rest = lambda x: strip(F.substring(x, F.length(first(x)) + 2, F.length(x)))
    return _pairs(blocks, lambda x: strip(F.regexp_replace(first(x), r"(?U)^\d+[.、．]\s*", "")), lambda x: strip(F.regexp_replace(rest(x), "^答:", "")))
