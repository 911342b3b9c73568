import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, WORD, fingerprint, groups, measured, odd_documents
from tidewheel.llm import queries as q

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_stages_and_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "quality classifier", "near-duplicates", "mix of sources", "packing",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() > 0


def test_stages_take_odd_rows_and_empty_tables(spark):
    odd = odd_documents(spark)
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, SF)
        if name != "packing":
            assert found.columns == odd.columns
        found.collect()
        assert stage(spark, none, SF).collect() == []


def test_rules_stage_is_that_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF01).collect()}
    for row in docs.collect():
        words, chars, symbols, repeated_lines, repeated = measured(row["text"])
        lines = sum(bool(WORD.search(x)) for x in (row["text"] or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in row["text"] or "")
        good = (
            words >= 20 and 100 * repeated <= 30 * words and 100 * symbols <= 25 * words
            and 100 * repeated_lines <= 60 * lines and 100 * capitals <= 50 * chars and 2 * words <= chars <= 25 * words
        )
        assert (row["doc_id"] in kept) == good


def test_clean_documents_stay_until_they_are_copies(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    ruled = corpus_pipeline.quality_rules(spark, good, SF01)
    long = good.where(F.size(F.split("text", " ")) >= 30)
    assert ruled.count() >= 0.99 * long.count()
    scored = corpus_pipeline.quality_classifier(spark, ruled, SF01)
    assert scored.count() >= 0.99 * ruled.count()


def test_bad_documents_go(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    bad = docs.join(spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 0").select("doc_id"), "doc_id")
    ids = {r["doc_id"] for r in bad.collect()}
    kept = corpus_pipeline.quality_classifier(spark, docs, SF01)
    assert sum(r["doc_id"] in ids for r in kept.collect()) <= 0.05 * len(ids)


def test_run_is_the_stages_one_after_another(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == copies


def test_simhash_query_is_that_of_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: fingerprint(t) for k, t in texts.items()}
    want = groups(prints)
    found = q.op6_simhash(spark, SF).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == prints
    assert {r["doc_id"]: r["component_id"] for r in found} == want


@pytest.mark.parametrize("name", q.QUERIES)
def test_queries_return_what_the_contract_says(spark, name):
    columns = {
        "op1_ann": "query_id bigint, rank int, vec_id bigint, score double",
        "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op3_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        "op4_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, fail_bits bigint",
        "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op8_html": "page_id bigint, url string, text string, n_chars bigint",
        "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op10_urls": "page_id bigint, host string, path string, rule string, verdict string",
        "op11_exact": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op12_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op13_periodic": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string",
    }
    df = q.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns[name]
    tables = {"op1": "embeddings", "op3": "conversations", "op8": "pages", "op10": "pages"}
    whole = spark.read.parquet(f"{SF}/{tables.get(name.split('_')[0], 'documents')}.parquet")
    counted = {
        "op1_ann": 5 * whole.where("vec_id % 50 = 0").count() if "vec_id" in whole.columns else None,
        "op3_chat": whole.select("conv_id").distinct().count() + 1 if "conv_id" in whole.columns else None,
    }
    n = df.count()
    if name == "op12_phrases":
        assert n == df.select("lang", "rank").distinct().count() <= 2000 * whole.select("lang").distinct().count()
        return
    assert n >= whole.count() if name == "op2_packing" else n == counted.get(name, whole.count())


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(q.QUERIES) | {"pipeline"} <= names
