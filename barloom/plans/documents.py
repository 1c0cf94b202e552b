"""Queries of documents and vectors (J, O, and the text rows of E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.functions import tables
from barloom.operators import ann, chunking, retrieval, text
from barloom.plans.catalog import query
from barloom.sources import disclosures, read
from barloom.sources.tables import scratch

COUNTED = """
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT doc_id, trim(line) AS line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2)"""


@query("e13_line_frequency", "WITH " + COUNTED.strip() + " SELECT doc_id, line, n FROM r WHERE n >= 3 AND length(line) <= 100")
def e13(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3 and length(line) <= 100")


@query("e14_top_words", "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word NOT IN ('the','and','that','les','des','que','die','der','und','los','las') GROUP BY 1, 2) SELECT lang, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 5")
def e14(spark, d):
    stop = ["the", "and", "that", "les", "des", "que", "die", "der", "und", "los", "las"]
    words = read(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).where(~F.col("word").isin(stop))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where("r <= 5").drop("r")


@query("j01_drop_repeated_lines", "WITH " + COUNTED.strip() + ", bad AS (SELECT doc_id, line FROM r WHERE n >= 3 AND length(line) <= 100), g AS (SELECT doc_id, list(line) AS bad FROM bad GROUP BY 1) SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x))), chr(10)), '') AS text FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL")
def j01(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", fn.drop_repeated_lines(F.col("text")).alias("text"))


@query("j02_drop_lines_any_length", "WITH " + COUNTED.strip() + ", g AS (SELECT doc_id, list(line) AS bad FROM r WHERE n > 2 GROUP BY 1) SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x)))) AS BIGINT) AS n_lines FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL")
def j02(spark, d):
    kept = fn.drop_repeated_lines(F.col("text"), 3, None)
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.when(kept == "", 0 * F.size(F.split("text", "\n"))).otherwise(F.size(F.split(kept, "\n"))).cast("long").alias("n_lines"))


@query("j03_normalise_space", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def j03(spark, d):
    return read(spark, d, "documents").select("doc_id", fn.normalise_space(F.col("text")).alias("text"))


STARTS, STOPS = ["^The and", "^Of", "^De"], ["The", "Of", "In", "Le", "Ein"]
BODY = "CASE " + " ".join(f"WHEN regexp_matches(raw_content, '(?m){x}') THEN regexp_extract(raw_content, '(?ms){x}(.*)\\z', 1)" for x in STARTS) + " END"
MARK = "|".join(STOPS)
TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
#: SQL of the narrative rules; {x} is the text
CLEAN = rf"nullif(regexp_replace(regexp_replace(regexp_replace({{x}}, '(?m)^[^\n]*\.{{{{3,}}}}\s*\d+\s*$', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '')"
SECTION = f"b AS (SELECT id, {BODY} AS body FROM disc), c AS (SELECT id, CASE WHEN regexp_matches(body, '(?m)^\\s*(?:{MARK})') THEN regexp_extract(body, '(?s)^(.*?)(?m:^)\\s*(?:{MARK})', 1) ELSE body END AS body FROM b), sec AS (SELECT id, {CLEAN.format(x=TRIM.format(x='body'))} AS section FROM c)"
HEAD = f"^([（(]\\s*[{text.NUMERALS}\\d]+\\s*[）)]|[①-⑩]|[{text.NUMERALS}\\d]+[.、．]|■|●|◆)"


def prose_sql(x: str) -> str:
    bare = TRIM.format(x="l")
    wide = r"regexp_matches(l, '\s{3,}')"
    keep = f"{bare} = '' OR {bare} LIKE '%。' OR regexp_matches({bare}, '{HEAD}')"
    drop = f"({wide} AND length({bare}) < 15) OR regexp_matches({bare}, '[\\d,.](?:\\)?%?\\s*\\(?-?[\\d,.]){{2}}') OR ({wide} AND length(regexp_replace({bare}, '[^一-龥]', '', 'g')) < 10)"
    return f"regexp_replace(array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep} OR NOT ({drop})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def paragraphs_sql(x: str) -> str:
    bare = TRIM.format(x="l")
    lines = f"string_split({x}, chr(10))"
    return f"""array_to_string(list_transform({lines}, lambda l, i: CASE WHEN {bare} = '' THEN '' WHEN regexp_matches({bare}, '[。！？"：;)\\]\\d]$') OR i = len({lines}) THEN {bare} || chr(10) ELSE {bare} END), '')"""


@query("j04_section", f"WITH {SECTION} SELECT id, section FROM sec", "disc")
def j04(spark, d):
    return disclosures(spark, d).select("id", text.section(F.col("raw_content"), STARTS, STOPS).alias("section"))


@query("j05_without_tables", f"SELECT id, {prose_sql('raw_content')} AS text FROM disc", "disc")
def j05(spark, d):
    return disclosures(spark, d).select("id", text.without_tables(F.col("raw_content")).alias("text"))


@query("j06_paragraphs", f"SELECT id, {paragraphs_sql('raw_content')} AS text FROM disc", "disc")
def j06(spark, d):
    return disclosures(spark, d).select("id", text.paragraphs(F.col("raw_content")).alias("text"))


@query("j07_narrative", f"WITH {SECTION}, t AS (SELECT id, {prose_sql('section')} AS t FROM sec) SELECT id, {paragraphs_sql('t')} AS text FROM t", "disc")
def j07(spark, d):
    cut = disclosures(spark, d).select("id", text.section(F.col("raw_content"), STARTS, STOPS).alias("t"))
    return cut.select("id", text.without_tables(F.col("t")).alias("t")).select("id", text.paragraphs(F.col("t")).alias("text"))


QA = "SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next FROM conversations WHERE text IS NOT NULL"


TRIMMED = f"WITH q AS ({QA}), p AS (SELECT conv_id, {TRIM.format(x='question')} AS question, {TRIM.format(x='answer')} AS answer FROM q WHERE role = 'user' AND next = 'assistant' AND NOT regexp_matches(question || answer, '[QA]:')) SELECT conv_id, question, answer FROM p WHERE question <> '' AND answer <> ''"


def turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, d, "conversations").where("text is not null").withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)})
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("j08_questions_and_answers", TRIMMED)
def j08(spark, d):
    """Each conversation written as one text with Q: and A:, and parsed back."""
    pairs = turns(spark, d).where("not (question || answer) rlike '[QA]:'")
    whole = pairs.groupBy("conv_id").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer")))).alias("text"))
    return whole.select("conv_id", F.explode(text.questions(F.concat(F.lit("minutes "), F.col("text")))).alias("p")).select("conv_id", "p.question", "p.answer")


@query("j09_pairs_to_chunks", f"WITH q AS ({QA}) SELECT conv_id, '问题：' || question || chr(10) || '回答：' || answer AS chunk FROM q WHERE role = 'user' AND next = 'assistant'")
def j09(spark, d):
    pairs = turns(spark, d).groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("question", "answer"))).alias("data"))
    each = pairs.select("conv_id", F.explode(F.from_json("data", "array<struct<question:string,answer:string>>")).alias("p"))
    return each.select("conv_id", F.concat(F.lit("问题："), F.col("p.question"), F.lit("\n回答："), F.col("p.answer")).alias("chunk"))


@query("j10_recursive_chunks")
def j10(spark, d):
    return chunking.chunks(disclosures(spark, d), "recursive")


#: sentences are folded one by one: what is held, and the chunk that a sentence closes; long chunks are cut in strides
SENTENCES = """
RECURSIVE s AS (SELECT id, regexp_extract(p, '^[^。！？\\n.?!]*[。！？\\n.?!]?') AS x, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM (
  SELECT id, CASE WHEN k > 1 THEN ltrim(p, E' \\t\\n\\r\\f\\v') ELSE p END AS p, k FROM (SELECT id, unnest(a) AS p, generate_subscripts(a, 1) AS k FROM (SELECT id, regexp_extract_all(raw_content, '[^。！？\\n.?!]*[。！？\\n.?!]\\s*|[^。！？\\n.?!]+') AS a FROM disc WHERE trim(raw_content, E' \\t\\n\\r\\f\\v') <> ''))) WHERE p <> ''),
f(id, i, held, length, out) AS (SELECT id, i, x, length(x), CAST(NULL AS VARCHAR) FROM s WHERE i = 1 UNION ALL
  SELECT s.id, s.i, CASE WHEN full_ THEN CASE WHEN tail <> '' THEN tail || ' ' || x ELSE x END ELSE held || ' ' || x END,
    CASE WHEN full_ THEN CASE WHEN tail <> '' THEN length(tail) + 1 + length(x) ELSE length(x) END ELSE length + length(x) + 1 END, CASE WHEN full_ THEN held END
  FROM (SELECT s.id, s.i, s.x, f.held, f.length, f.length + length(s.x) > 450 AS full_,
    ltrim(CASE WHEN regexp_matches(right(f.held, 50), '[。！？\\n.?!]') THEN regexp_replace(right(f.held, 50), '^[^。！？\\n.?!]*[。！？\\n.?!]', '') ELSE right(f.held, 50) END, E' \\t\\n\\r\\f\\v') AS tail FROM f JOIN s ON s.id = f.id AND s.i = f.i + 1) s),
c AS (SELECT id, i, out AS x FROM f WHERE out IS NOT NULL UNION ALL SELECT id, i + 1, held FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i, o) - 1 AS INTEGER) AS chunk_order, CASE WHEN length(x) <= 540 THEN x ELSE substr(x, CAST(o + 1 AS BIGINT), 450) END AS chunk_text
FROM (SELECT id, i, x, unnest(CASE WHEN length(x) <= 540 THEN [0] ELSE generate_series(0, length(x) - 1, 400) END) AS o FROM c)"""


@query("j11_sentence_chunks", "WITH " + SENTENCES.strip(), "disc")
def j11(spark, d):
    return chunking.chunks(disclosures(spark, d), "sentence")


#: lines are folded one by one: the pack and its length
PACKED = """
RECURSIVE l AS (SELECT id, unnest(string_split(raw_content, chr(10))) AS x, generate_subscripts(string_split(raw_content, chr(10)), 1) AS i FROM disc WHERE trim(raw_content, E' \\t\\n\\r\\f\\v') <> ''),
f(id, i, x, pack, length) AS (SELECT id, i, CASE WHEN length(x) + 1 > 10000 THEN x ELSE chr(10) || x END, 0, CASE WHEN length(x) + 1 > 10000 THEN length(x) ELSE length(x) + 1 END FROM l WHERE i = 1 UNION ALL
  SELECT l.id, l.i, CASE WHEN f.length + length(l.x) + 1 > 10000 THEN l.x ELSE chr(10) || l.x END, CASE WHEN f.length + length(l.x) + 1 > 10000 THEN f.pack + 1 ELSE f.pack END,
    CASE WHEN f.length + length(l.x) + 1 > 10000 THEN length(l.x) ELSE f.length + length(l.x) + 1 END FROM f JOIN l ON l.id = f.id AND l.i = f.i + 1)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pack) - 1 AS INTEGER) AS chunk_order, x AS chunk_text FROM (SELECT id, pack, string_agg(x, '' ORDER BY i) AS x FROM f GROUP BY 1, 2) WHERE x <> ''"""


@query("j12_paragraph_packs", "WITH " + PACKED.strip(), "disc")
def j12(spark, d):
    return chunking.chunks(disclosures(spark, d), "paragraph")


STRIDES = "SELECT doc_id, CAST(i / 400 AS INTEGER) AS chunk_order, substr(text, CAST(i + 1 AS BIGINT), 450) AS chunk_text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1), 400)) AS i FROM documents WHERE text <> '')"


@query("j13_stride_chunks", STRIDES)
def j13(spark, d):
    at = F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(400))).alias("chunk_order", "i")
    return read(spark, d, "documents").where("text <> ''").select("doc_id", "text", at).select("doc_id", "chunk_order", F.substring("text", F.col("i") + 1, F.lit(450)).alias("chunk_text"))


def _by_table_function(spark, d, splitter):
    """The chunks of j10 to j12 by a lateral join with the table function."""
    tables.register(spark)
    docs = disclosures(spark, d).select("id", "raw_content")
    return spark.sql("SELECT d.id, c.* FROM {docs} d, LATERAL split_text(d.raw_content, '" + splitter + "') c", docs=docs)


@query("r05_recursive_chunks")
def r05_recursive(spark, d):
    return _by_table_function(spark, d, "recursive")


@query("r05_sentence_chunks", "WITH " + SENTENCES.strip(), "disc")
def r05_sentence(spark, d):
    return _by_table_function(spark, d, "sentence")


@query("r05_paragraph_packs", "WITH " + PACKED.strip(), "disc")
def r05_paragraph(spark, d):
    return _by_table_function(spark, d, "paragraph")


@query("r05_stride_chunks", STRIDES)
def r05_stride(spark, d):
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL stride_text(d.text, 450, 50) c", docs=read(spark, d, "documents"))


@query("r05_packed_lines", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f(doc_id, i, x, pack, length) AS (SELECT doc_id, i, x, 0, length(x) FROM l WHERE i = 1 UNION ALL
  SELECT l.doc_id, l.i, l.x, CASE WHEN f.length + length(l.x) + 1 > 300 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.length + length(l.x) + 1 > 300 THEN length(l.x) ELSE f.length + length(l.x) + 1 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, CAST(pack AS INTEGER) AS chunk_order, string_agg(x, chr(10) ORDER BY i) AS chunk_text FROM f GROUP BY 1, pack""")
def r05_packed(spark, d):
    """Lines of documents packed in order by a table function over partitions of a table."""
    tables.register(spark)
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return spark.sql("SELECT * FROM pack_rows(TABLE(SELECT * FROM {lines}) PARTITION BY doc_id ORDER BY (line_no), 'line', 300)", lines=lines)


@query("j14_number_chunks", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_order, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''")
def j14(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_order", "line")).where("trim(line) <> ''")


@query("j15_normalise_vectors", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 4) AS total, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def j15(spark, d):
    unit = retrieval.normalised("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("embedding").alias("dims"))


COS = "round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5)"


@query("o01_nearest_in_symbol", f"SELECT q.label, e.vec_id, {COS} AS distance FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) q ON q.label = e.label AND q.vec_id <> e.vec_id QUALIFY row_number() OVER (PARTITION BY q.label ORDER BY {COS}, e.vec_id) <= 5")
def o01(spark, d):
    vectors = read(spark, d, "embeddings").where("embedding is not null")
    asked = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("own"))
    rows = vectors.join(asked, "label").where("vec_id <> own").select("label", "vec_id", F.round(retrieval.cosine_distance("embedding", "q"), 5).alias("distance"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("distance", "vec_id"))).where("r <= 5").drop("r")


DATED = "DATE '2020-01-01' + CAST(e.vec_id % 1826 AS INTEGER)"


@query("o02_nearest_in_dates", f"SELECT e.vec_id, {DATED} AS ann_date, {COS.replace('e.embedding', 'CASE WHEN e.vec_id % 50 <> 7 THEN e.embedding END')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE {DATED} BETWEEN DATE '2020-02-01' AND DATE '2020-03-31' ORDER BY distance NULLS LAST, e.vec_id LIMIT 70")
def o02(spark, d):
    """The nearest chunks of a range of dates; those without a vector come last."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 1826).cast("int"))
    vectors = read(spark, d, "embeddings").withColumn("ann_date", day)
    target = F.broadcast(vectors.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1))  # one row
    some = vectors.where("ann_date between date'2020-02-01' and date'2020-03-31'").withColumn("embedding", F.when(F.col("vec_id") % 50 != 7, F.col("embedding")))
    rows = some.crossJoin(target).select("vec_id", "ann_date", F.round(retrieval.cosine_distance("embedding", "q"), 5).alias("distance"))
    return rows.orderBy(F.asc_nulls_last("distance"), "vec_id").limit(70)


BUCKETS = [(0, 0, 365, 3), (1, 365, 1095, 2), (2, 1095, 100000, 1)]


@query("o03_topics_and_buckets", f"WITH q AS (SELECT vec_id AS topic, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)), b(bucket, lo, hi, k) AS (VALUES {', '.join(map(str, BUCKETS))}), n AS (SELECT q.topic, b.bucket, e.vec_id AS id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance, b.k FROM embeddings e, q, b WHERE (e.vec_id * 7) % 2000 BETWEEN b.lo AND b.hi), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY topic, bucket ORDER BY distance, id) <= k) SELECT topic, bucket, id, distance FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY topic, bucket) = 1")
def o03(spark, d):
    vectors = read(spark, d, "embeddings").where("embedding is not null")
    topics = vectors.where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("topic"), F.col("embedding").alias("q")).limit(3)
    return retrieval.by_topic_and_age(vectors.select(F.col("vec_id").alias("id"), ((F.col("vec_id") * 7) % 2000).alias("age"), "embedding"), topics, BUCKETS)


def _asked(vectors):
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("o05_index_search")
def o05(spark, d):
    """About the 10 nearest vectors of every one whose id is divisible by 100, from an index over all of them."""
    vectors = read(spark, d, "embeddings")
    index = ann.Index.build(vectors, scratch(spark, "index"))
    return index.search(_asked(vectors), vectors)


@query("o05_index_recall", "SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings) - 1) AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def o05_recall(spark, d):
    """For each of those queries how many neighbours it has, and whether the index found 0.9 of all of them; the truth by brute force."""
    vectors = read(spark, d, "embeddings")
    index = ann.Index.build(vectors, scratch(spark, "index"))
    rows = ann.recall(index.search(_asked(vectors), vectors), ann.exact(vectors, _asked(vectors)))
    total = rows.agg((F.sum("hit") >= 0.9 * F.sum("wanted")).alias("reached"))  # one row
    return rows.select("query_id", "wanted").crossJoin(F.broadcast(total))
