"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Defined results: rows are judged one by one, so repeated ids and null ids do no harm. A null or empty text is toxic only if
the classifier scores an empty text so, a copy of all other empty texts (the row of the largest id stays), near to nothing,
never contaminated, and mixed by its domain's prior. Of equal rows one stays. Empty tables go through empty; without labels
no row is toxic and every rate is 1; without benchmark items nothing is contaminated. Texts of any length are taken whole.
Columns of the table are kept as they are; the last stage adds n_tokens, domain, domain_weight and rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import decontam, exact_dedup, mixing, ngram_join, toxicity
from lintel.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents at or over their language's threshold go; a null language has the common one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.withColumnRenamed("score", "__lx_score"), model)
    own = [F.col("__lx_score").alias(c) if c == "score" else F.col(c) for c in docs.columns]
    return scored.where(F.col("score") < toxicity.threshold_of(model)).select(*own)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts (A-Z lower-cased, null as empty) the one of the largest doc_id stays; null ids come last."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component of near copies the one of the smallest doc_id stays; null ids come last."""
    return ngram_join.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document with its rate; those of rate 0, which no mix draws, go."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels")).where("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]
#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
