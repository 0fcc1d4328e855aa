"""The pipeline's stages, each on its predecessor's result."""

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintel.llm import mixing, queries
from tests.llm.test_copies import jaccard_truth
from tests.llm.test_texts import ASCII, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "one two three four five six seven eight nine ten"
BAD = ["idiot", "moron", "scum"]


def made_rows():
    """Clean and toxic rows, half of them labelled; copies, near copies, benchmark passages, odd rows."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(500):
        w = [f"{'en' if k % 3 else 'fr'}{rng.randrange(400)}" for _ in range(rng.randrange(30, 60))]
        if k % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((k, " ".join(w), "en" if k % 3 else "fr", f"s{k % 5}", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + r[0], r[1].upper() if r[0] % 8 == 1 else r[1], *r[2:]) for r in clean[:20]]  # exact copies
    rows += [(2000 + r[0], r[1] + " more", *r[2:]) for r in clean[20:40]]  # near copies
    rows += [(3000, f"x {ITEM} y", "en", "s", 1), (1, f"as {ITEM} has it", "en", "s", 1), (None, f"or {ITEM}", "en", "s", 1)]
    rows += [(4000, None, None, None, None), (4001, "", "en", None, 0), (None, "no id at all here", "fr", "s", 1), (2, "another text with an id that is there already", "en", "s", 1)]
    rows += [clean[50], clean[50]]  # repeated rows
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, labels = made_rows()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([*labels, (9999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    # toxicity: a trained model decides; toxic rows go, clean ones stay
    kept = corpus_pipeline.staged(by_name["toxicity"](spark, docs, folder))
    assert kept.columns == columns
    ids = [r["doc_id"] for r in kept.collect()]
    held = [k for k in range(500) if crc32(str(k).encode()) % 4 == 2]
    toxic, clean = [k for k in held if k % 4 == 0], [k for k in held if k % 4]
    assert sum(k in ids for k in toxic) <= 0.1 * len(toxic) and sum(k in ids for k in clean) >= 0.95 * len(clean)
    # exact dedup: of equal texts the row of the largest id
    best = {}
    for r in as_rows(kept):
        key = (r[1] or "").translate(ASCII)
        best[key] = max(best.get(key, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    kept = corpus_pipeline.staged(by_name["exact dedup"](spark, kept, folder))
    assert kept.columns == columns and [r[:2] for r in as_rows(kept)] == sorted((r[:2] for r in best.values()), key=str)
    # near copies: the row of the smallest id of each component
    rows = as_rows(kept)
    truth = jaccard_truth([(k, r[1]) for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))])
    kept = corpus_pipeline.staged(by_name["n-gram Jaccard join"](spark, kept, folder))
    assert kept.columns == columns and kept.count() == sum(me == component for me, _, component, _ in truth) < len(rows)
    # benchmark passages
    item = words(ITEM)
    want = [r for r in as_rows(kept) if not any(words(r[1])[k : k + 10] == item for k in range(len(words(r[1]))))]
    before = kept.count()
    kept = corpus_pipeline.staged(by_name["benchmark decontamination"](spark, kept, folder))
    assert kept.columns == columns and as_rows(kept) == want and len(want) == before - 3
    # mixing: all rows of positive rate, with their rates
    out = by_name["mixing sources to target weights"](spark, kept, folder)
    assert out.columns == [*columns, "n_tokens", "domain", "domain_weight", "rate"]
    assert as_rows(out.select(*columns)) == want and out.where("rate <= 0 or rate is null").count() == 0
    whole = corpus_pipeline.run(spark, folder)
    assert as_rows(whole.select("doc_id", "text")) == as_rows(out.select("doc_id", "text"))


def test_rates_of_an_unwanted_domain(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = mixing.mixed(docs, labels, {"en": 1.0, "fr": 0.0}).where("domain_weight > 0.99").groupBy("domain").agg(F.max("rate").alias("most"))
    most = {r["domain"]: r["most"] for r in out.collect()}
    assert most["en"] > 1 and most.get("fr", 0) < 0.05


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= names and len(corpus_pipeline.STAGES) == 5
