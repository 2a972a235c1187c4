"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import chat, decontam, langid, licenses, packing, rabitq, simhash, substring, tokenbin, toxicity
from tessera.llm.common import map_batches


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: A conversation whose texts hold control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(PROBE[0], k, role, PROBE[1]) for k, role in enumerate(("user", "assistant"))], schema)
    rows = _table(spark, sf_dir, "conversations").select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))))
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = substring.deduplicate(docs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [substring.kept_digest(substring.split_words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(cut, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op10_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokenbin.read_documents(manifest)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document of nothing else goes."""
    cut = substring.deduplicate(docs)
    n_words, n_removed = cut.columns[-2:]
    cut = cut.where((F.col(n_removed) == 0) | (F.col(n_words) > F.col(n_removed)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_substring": op4_substring,
    "op5_rabitq": op5_rabitq,
    "op6_packing": op6_packing,
    "op7_langid": op7_langid,
    "op8_licenses": op8_licenses,
    "op9_decontam": op9_decontam,
    "op10_tokenbin": op10_tokenbin,
}

_ESCAPES = r"(length(t) - length(replace(t, '\', '')) + length(t) - length(replace(t, '#', '')) + length(t) - length(replace(t, '<', '')))"
_ROLE_ESCAPES = _ESCAPES.replace("(t", "(r").replace("<', '')))", "<', '')) + length(r) - length(replace(r, ':', '')))")

ORACLE_SQL = {
    "op3_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE[1]}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE[1]}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('### : ' || ' </turn>') + 1 + length(r) + length(t) + {_ESCAPES} + {_ROLE_ESCAPES})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op4_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT x.doc_id, x.i FROM x JOIN f ON x.h = f.h WHERE f.first < x.doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
m AS (SELECT p.doc_id, p.j, p.word,
        max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.j = r.i),
k AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op5_rabitq": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
