"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import langid, mixing, toxicity
from lintel.llm.chain_dedup import passage_pairs, shared_passages
from lintel.llm.chat import format_chats, loss_text, parse
from lintel.llm.common import bernoulli_fold, table
from lintel.llm.decontam import contamination
from lintel.llm.exact_dedup import exact_groups
from lintel.llm.licenses import license_scan
from lintel.llm.ngram_join import jaccard_components
from lintel.llm.suffix_dedup import remove_repeats


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base_hits", lambda h: h["s"].cast("long"))
    labels = lambda hits: F.transform(hits, lambda h: h["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_hits").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("base_hits")).alias("base_labels"),
        joined(F.concat(labels("base_hits"), labels("hits"))).alias("labels"),
        "score",
    )


def op3_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the license scan SQL can express."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: What one text of conversation -7 says.
PLANTED = "\\### Assistant: </turn> ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": said, "text": F.lit(PLANTED)}
    planted = spark.range(2).select(*[own[f.name].cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    made = format_chats(rows.unionByName(planted))
    read = made.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=2, parts=4)
    scored = toxicity.score_documents(docs, model, keep=["doc_id", "lang"])
    return scored.select(
        "doc_id",
        F.coalesce(bernoulli_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold_of(model)).alias("flagged"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source"])
    return found.select("doc_id", "source", "n_tokens", "domain", "domain_weight", "rate", (F.col("n_tokens") * F.col("rate")).alias("expected_tokens"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, fold=0, parts=5))
    return found.withColumn("held_out", F.coalesce(bernoulli_fold(F.col("doc_id"), 5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def op10_passage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_pairs(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g
  FROM d
),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, coalesce(k, 0) AS n_links FROM n JOIN least USING (doc_id) LEFT JOIN many USING (doc_id)
"""

OP3_BASE_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
hits AS (
  SELECT doc_id, i - 1 AS place, CASE w[i] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  WHERE (w[i] IN ('mit', 'apache') AND w[i + 1] = 'license') OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')
),
f AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels
FROM d LEFT JOIN f USING (doc_id)
"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, w[i : i + 9] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item FROM grams JOIN wins USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "replace(replace(replace(coalesce({}, ''), '\\', '\\\\'), '<', '\\l'), '#', '\\h')"
OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, ':', '\\c')) + {len("<turn>### : </turn>") + 1}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256({_LOWER}) AS sha FROM documents)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_license_scan": op3_license_scan,
        "op3_base_places": op3_base_places,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_toxicity": op6_toxicity,
        "op7_source_mixing": op7_source_mixing,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op10_passage_pairs": op10_passage_pairs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op2_benchmark_decontamination": OP2_SQL,
        "op3_base_places": OP3_BASE_SQL,
        "op5_chat_formatting": OP5_SQL,
        "op9_exact_dedup": OP9_SQL,
    }
