import pytest
from pyspark.sql import functions as F
from test_entry import same

import corpus_pipeline
from pathloom.llm import common, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    same(spark, FOLDER, name)


COLUMNS = {
    "op1_toxicity_lexicon": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_quality_pairs": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_media_ogg": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_token_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}, "op9_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op10_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_results_have_the_columns_agreed_and_all_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert dict(df.dtypes) == COLUMNS[name]
    if name != "op7_chat_format":
        assert df.count() == common.table(spark, FOLDER, "documents").count()
    else:
        assert df.where("conv_id = -7").first()["n_turns"] == 2


def test_pipeline(spark):
    """Stage by stage: what is kept is part of what came, as it came, and each decision takes effect."""
    docs = common.table(spark, FOLDER, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, FOLDER), "stage")
        assert out.columns == columns and out.subtract(docs).count() == 0, name
        if name.startswith("SimHash"):
            assert out.count() < docs.count()
            assert queries.simhash.keep_one(out).count() == out.count()
        if name.startswith("benchmark"):
            assert queries.decontam.report(queries.decontam.hits(out, common.table(spark, FOLDER, "benchmark"))).where("contaminated").count() == 0
        docs = out
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.agg(F.sum("ids_crc32")).first() == got.agg(F.sum("ids_crc32")).first()
