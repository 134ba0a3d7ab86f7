"""The registered queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, decontaminate, exact_dedup, hmm_lm, jaccard_join, packing, quality, substring_dedup, toxicity, warc
from palimpsest.llm.common import read_table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n_shingles, md5(array_to_string(list_sort(grams), chr(10))) AS digest FROM g),
k AS (SELECT doc_id, n_shingles, CASE WHEN n_shingles > 0 THEN min(doc_id) OVER (PARTITION BY digest) ELSE doc_id END AS class_id FROM n),
s AS (SELECT g.doc_id, n_shingles, unnest(grams) AS gram FROM g JOIN k ON g.doc_id = k.doc_id AND k.doc_id = k.class_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 90 * (a.n_shingles + b.n_shingles - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM k WHERE doc_id = class_id UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x AS class_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n_shingles, class_id, component_id FROM k JOIN c USING (class_id)
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
h AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS said FROM s),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY said) AS first_id FROM h),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS p FROM m WHERE first_id < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(places, []), i)) AS stay FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(words) - len(stay) AS n_removed, sha256(coalesce(array_to_string(list_transform(stay, lambda i: words[i]), ' '), '')) AS kept_sha256 FROM k
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> s) & 31) AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM b
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.formatted(chat_format.threads(said.unionByName(more))))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(role) + 8 + escaped + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), quality.grades_of(read_table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_hmm_lm": op3_hmm_lm,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_format": op8_chat_format,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op8_chat_format": OP8_SQL}
