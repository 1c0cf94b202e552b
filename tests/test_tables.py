import pytest

from barloom.functions import tables
from barloom.operators import chunking
from barloom.plans import catalog
from tests.oracle import rows_of


@pytest.fixture()
def sql(spark):
    tables.register(spark)
    docs = [(1, "One. Two. Three.", 1), (2, None, 2), (3, "", 3), (4, "  \n ", 4), (5, "x" * 25, 5), (5, "x" * 25, 5)]
    spark.createDataFrame(docs, "id int, text string, chunk_order int").createOrReplaceTempView("texts")
    lines = [(1, 2, "aa", 9), (1, 1, "bbb", 9), (1, 3, "c", 9), (2, 1, "x" * 9, 9), (2, 2, None, 9), (2, 3, "", 9), (2, 4, "y", 9), (3, 1, None, 9)]
    spark.createDataFrame(lines, "id long, n int, line string, size int").createOrReplaceTempView("text_lines")
    return lambda q: sorted(map(tuple, spark.sql(q).collect()))


@pytest.mark.parametrize("name", ["recursive", "sentence", "paragraph"])
def test_the_table_function_makes_the_same_chunks(spark, sf, name):
    query = {"recursive": "j10_recursive_chunks", "sentence": "j11_sentence_chunks", "paragraph": "j12_paragraph_packs"}[name]
    other = {"recursive": "r05_recursive_chunks", "sentence": "r05_sentence_chunks", "paragraph": "r05_paragraph_packs"}[name]
    assert rows_of(catalog.QUERIES[other](spark, sf)) == rows_of(catalog.QUERIES[query](spark, sf))


def test_lateral_join(sql):
    assert sql("SELECT t.id, c.* FROM texts t, LATERAL split_text(t.text, 'sentence', 9, 0) c WHERE t.id < 5") == [(1, 0, "One. Two."), (1, 1, "Three.")]
    assert sql("SELECT t.id, c.* FROM texts t, LATERAL split_text(t.text, 'recursive', 10, 0) c WHERE t.id = 5") == sorted([(5, i, "x" * n) for i, n in enumerate((10, 10, 5))] * 2)
    assert sql("SELECT id, c.chunk_order, chunk_text FROM texts, LATERAL stride_text(text, 10, 2) c WHERE id = 5") == sorted([(5, i, "x" * n) for i, n in enumerate((10, 10, 9, 1))] * 2)
    whole = sql("SELECT t.id, c.chunk_order FROM texts t LEFT JOIN LATERAL split_text(t.text, 'paragraph') c ON true")
    assert [i for i, order in whole if order is None] == [2, 3, 4]  # an outer join keeps texts without chunks
    assert sql("SELECT * FROM split_text('a b', 'recursive')") == [(0, "a b")]


def test_pack_rows_of_a_partition(sql):
    packed = "SELECT * FROM pack_rows(TABLE(text_lines) PARTITION BY id ORDER BY (n), 'line', {})"
    assert sql(packed.format(6)) == [(1, 0, "bbb\naa"), (1, 1, "c"), (2, 0, "x" * 9), (2, 1, "\ny")]
    assert sql(packed.format(100)) == [(1, 0, "bbb\naa\nc"), (2, 0, "x" * 9 + "\n\ny")]
    assert sql("SELECT * FROM pack_rows(TABLE(SELECT * FROM text_lines WHERE false) PARTITION BY id ORDER BY (n), 'line', 6)") == []


@pytest.mark.parametrize("call, message", [
    ("split_text(t.text, 'words')", "has to be one of"), ("split_text(t.id, 'sentence')", "has to be a string"), ("split_text(t.text, 'sentence', 0)", "at least 1"), ("split_text(t.text, 'sentence', t.id)", "constant"),
    ("split_text(t.text, 'sentence', 5, 5)", "smaller"), ("split_text(t.text, 'paragraph', 5, 1)", "no overlap"), ("stride_text(t.text, 4, 4)", "smaller"),
])
def test_wrong_arguments_fail_in_analysis(spark, sql, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT c.* FROM texts t, LATERAL {call} c")


def test_wrong_columns_fail_in_analysis(spark, sql):
    with pytest.raises(Exception, match="one of id, n, line, size"):
        spark.sql("SELECT * FROM pack_rows(TABLE(text_lines) PARTITION BY id ORDER BY (n), 'nothing', 6)")


def test_chunks_of_long_texts_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "HELD", 10)
    docs = spark.createDataFrame([(i, "ab cd " * 4 if i % 3 else None) for i in range(20)], "id int, raw_content string")
    got = sorted(map(tuple, chunking.chunks(docs, "recursive", size=6, overlap=0).collect()))
    assert got == [(i, k, x) for i in range(20) if i % 3 for k, x in enumerate(chunking.recursive_chunks("ab cd " * 4, 6, 0))]
