"""Table functions for SQL: splitters of texts, and a packer of ordered rows.

``register(spark)`` makes them known to the session:

    SELECT d.id, c.* FROM docs d, LATERAL split_text(d.text, 'sentence', 450, 50) c
    SELECT * FROM pack_rows(TABLE(lines) PARTITION BY id ORDER BY (line_no), 'line', 10000)

Their schema is made when the query is analysed, and wrong arguments fail there.  Rows travel to Python in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barloom.operators.chunking import SPLITTERS

CHUNK = StructType([StructField("chunk_order", IntegerType()), StructField("chunk_text", StringType())])


def _number(argument: AnalyzeArgument | None, name: str, least: int) -> None:
    """A whole number that is known when the query is analysed."""
    if argument is not None and (not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < least):
        raise ValueError(f"{name} has to be a constant whole number of at least {least}")


class SplitText:
    """split_text(text, splitter, size, overlap): the chunks of one text in order; null and blank texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, splitter: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument has to be a string")
        if not splitter.isConstantExpression or splitter.value not in SPLITTERS:
            raise ValueError(f"the splitter has to be one of {', '.join(sorted(SPLITTERS))}")
        if overlap is not None and splitter.value == "paragraph":
            raise ValueError("the paragraph splitter has no overlap")
        _number(size, "size", 1)
        _number(overlap, "overlap", 0)
        if size is not None and overlap is not None and overlap.value >= size.value:
            raise ValueError("the overlap has to be smaller than the size")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, splitter: str, size: int | None = None, overlap: int | None = None):
        if text and text.strip():
            options = {k: v for k, v in (("size", size), ("overlap", overlap)) if v is not None}
            yield from enumerate(SPLITTERS[splitter](text, **options))


class StrideText:
    """stride_text(text, size, overlap): pieces of ``size`` characters, each beginning size - overlap after the one before."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _number(size, "size", 1)
        _number(overlap, "overlap", 0)
        if overlap.value >= size.value:
            raise ValueError("the overlap has to be smaller than the size")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, size: int, overlap: int):
        if text:
            yield from ((k, text[i : i + size]) for k, i in enumerate(range(0, len(text), size - overlap)))


class PackRows:
    """pack_rows(TABLE(t) PARTITION BY key ORDER BY (place), column, size): strings of a column joined by line ends while fewer than
    ``size`` characters come together, a longer one alone; only the pack at hand is held.  Null strings are left out.

    The rows begin with the columns that come before the packed one.
    """

    def __init__(self, *_) -> None:
        self.key, self.held, self.length, self.order = None, [], 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        names = rows.dataType.fieldNames()
        if not column.isConstantExpression or column.value not in names:
            raise ValueError(f"the column has to be one of {', '.join(names)}")
        _number(size, "size", 1)
        return AnalyzeResult(StructType(rows.dataType.fields[:1] + CHUNK.fields))

    def _pack(self):
        row = (self.key, self.order, "\n".join(self.held))
        self.order, self.held, self.length = self.order + 1, [], 0
        return row

    def eval(self, row, column: str, size: int):
        self.key = row[0]
        text = row[column]
        if text is None:
            return
        if self.held and self.length + len(text) + 1 > size:
            yield self._pack()
        self.length += len(text) + bool(self.held)
        self.held.append(text)

    def terminate(self):
        if self.held:
            yield self._pack()


FUNCTIONS = {"split_text": SplitText, "stride_text": StrideText, "pack_rows": PackRows}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, useArrow=True))
