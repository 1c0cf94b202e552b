"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN, path

from . import bpe, decontaminate, elkan, licenses, maxent, near_dedup, pseudonyms, quality, sharding, substring_dedup, token_files, vector_codes, vector_search
from ._session import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units."""
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with personal data replaced by keyed pseudonyms of the same format, and counts by kind."""
    out = pseudonyms.pseudonymise(_read(spark, sf_dir, "documents"), key="fixed key of the query")
    return out.select("doc_id", "text", *[f"n_{k}" for k in pseudonyms.KINDS])


def op3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every vector whose id is divisible by 100 against all others."""
    vectors = _read(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements and grants in whole texts, with their containment."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a machine fitted on labels outside the held-out fold."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()), metadata=["n_chars"])
    out = quality.score(docs, model, metadata=["n_chars"], threshold=0.3)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of whole texts and the bytes that the ids decode to, as digests."""
    ranks = path("byte_bpe_50k.tiktoken")
    out = bpe.encode(_read(spark, sf_dir, "documents"), ranks, PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of whole texts by smoothed counts and by the maximum-entropy model."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return maxent.score(_read(spark, sf_dir, "documents"), held_out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the words of repeated 13-word windows are cut out."""
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), size=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over distinct 3-word shingles at a similarity of 0.85."""
    out = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in three arrivals and compacted to shards of 32 MB: the rows of the last version, and whether their shard is in its manifest."""
    docs = _read(spark, sf_dir, "documents")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    store = sharding.ingest(docs, [turn == 0, turn == 1, turn == 2], scratch(spark, "shards"), target_bytes=32 << 20)
    version, shards = store.manifest()
    # the last version's shards: as many as the data have targets, and a few small ones a tier
    named = F.broadcast(spark.createDataFrame([(x.file,) for x in shards], "file string"))
    rows = store.read(version, shard="file").join(named.withColumn("in_manifest", F.lit(True)), "file", "left")
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars", F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts of every vector, their errors, the errors of each label and the digest of the codebooks."""
    coded, books = vector_codes.compress(_read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    out = vector_codes.with_sum(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of 8 centroids of every vector after 10 rounds, with distances and inertias."""
    assigned, found = elkan.cluster(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")
    return elkan.with_inertia(assigned, found)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts written in coded blocks in doc_id order: where each document lies, and its checksum, from the files."""
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    at = scratch(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), tokenizer, at, end=0)
    return token_files.documents(spark, at)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_vector_topk": op3_vector_topk,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_maxent": op7_maxent,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_elkan": op12_elkan,
    "op13_token_files": op13_token_files,
}


def _license_sql() -> str:
    """Containment of every template in every window of its class, without MinHash."""
    size_of = licenses.classes(licenses.TEMPLATES)
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = licenses.words_of(text)
        stride, wide = licenses.shape(size_of[name])
        own = sorted({" ".join(words[i : i + licenses.SHINGLE]) for i in range(len(words) - licenses.SHINGLE + 1)})
        rows.append(f"('{name}', {stride}, {wide}, [{', '.join(repr(x) for x in own)}])")
    values = ", ".join(rows)
    return f"""
WITH t(license, stride, wide, own) AS (VALUES {values}), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) AS sh FROM d WHERE len(w) >= 5
), p AS (
  SELECT doc_id, license, stride, wide, own, sh, unnest(generate_series(0, len(sh) - 1, stride)) AS pos
  FROM s JOIN t ON list_has_any(sh, own)
), c AS (
  SELECT doc_id, license, pos, len(list_intersect(list_distinct(sh[pos + 1:pos + wide]), own)) / len(own) AS containment FROM p
)
SELECT doc_id, license, max(containment) AS containment, arg_max(pos, containment * 1e9 - pos) AS word
FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
"""


_VECTORS = """v AS MATERIALIZED (
  SELECT vec_id, {keep}, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)"""
_SQUARED = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _codes_sql(rounds: int = 2) -> str:
    """Product codes by plain assignments of every part to all entries, one CTE a round."""
    text = f"""
WITH {_VECTORS.format(keep="label", scale=256)}, p AS MATERIALIZED (
  SELECT vec_id, label, part, e[part * (len(e) // 16) + 1:(part + 1) * (len(e) // 16)] AS x FROM v, (SELECT unnest(generate_series(0, 15)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
)"""
    for r in range(rounds + 1):
        text += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.*, entry, {_SQUARED.format(a="x", b="c")} AS d FROM p JOIN b{r} USING (part)) GROUP BY ALL
)"""
        if r < rounds:
            text += f""", m{r} AS MATERIALIZED (
  SELECT part, entry, list({_FLOOR} ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT *, unnest(generate_series(1, len(x))) AS pos FROM a{r}) GROUP BY ALL
  ) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))"""
    return text + f""", o AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM o
"""


def _clusters_sql(rounds: int = 10) -> str:
    """Plain rounds without bounds, one CTE a round."""
    text = f"""
WITH {_VECTORS.format(keep="len(embedding) AS dims", scale=1024)}, p AS MATERIALIZED (SELECT vec_id, e AS x FROM v WHERE dims = 64), b0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, x AS c FROM p ORDER BY sha256('3:' || vec_id) LIMIT 8
)"""
    for r in range(rounds + 1):
        text += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, x, arg_min(cluster, d * 8 + cluster) AS cluster, min(d) AS distance FROM (SELECT p.*, cluster, {_SQUARED.format(a="x", b="c")} AS d FROM p, b{r}) GROUP BY ALL
)"""
        if r < rounds:
            text += f""", m{r} AS MATERIALIZED (
  SELECT cluster, list({_FLOOR} ORDER BY pos) AS c FROM (
    SELECT cluster, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT *, unnest(generate_series(1, 64)) AS pos FROM a{r}) GROUP BY ALL
  ) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (cluster))"""
    return text + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN b{rounds} USING (cluster)
"""


ORACLE_SQL = {
    "op11_vector_codes": _codes_sql(),
    "op12_elkan": _clusters_sql(),
    "op10_sharding": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars, true AS in_manifest FROM documents",
    "op4_licenses": _license_sql(),
    "op3_vector_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(c.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p WHERE i + 12 <= len(w)
), low AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k
), bad AS (
  SELECT win.doc_id, win.i FROM win JOIN low USING (k) WHERE low.m < win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM bad, (SELECT unnest(generate_series(0, 12)) AS o)
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i WHERE gone.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op9_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), low AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
""",
}
