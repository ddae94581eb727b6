"""The registered queries over the smallest tables: against SQL where there is some, else against plain versions."""

import hashlib

import pytest
from brute import base_spans, contained_items, jaccard_classes, repeated_words
from compare import differences, duckdb_tables

from skylag.llm import sentencepiece_bpe
from skylag.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), duckdb_tables(SF_DIR), ORACLE[name]) == []


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def test_sentencepiece_equals_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.PATH)
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for d, text in texts:
        ids = model.encode(text)
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["round_trip"]) == (len(ids), digest, True)


def test_decontamination_finds_all_whole_items(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontaminate"](spark, SF_DIR).collect()}
    assert contained_items(texts, items) <= got


def test_jaccard_equals_all_pairs(spark, texts):
    components, sizes = jaccard_classes(texts)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in QUERIES["op4_ngram_jaccard_join"](spark, SF_DIR).collect()}
    assert got == {d: (components[d], sizes[d]) for d, _ in texts}


def test_substring_dedup_equals_one_pass(spark, texts):
    got = sorted(map(tuple, QUERIES["op5_substring_dedup"](spark, SF_DIR)
                     .select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == repeated_words(texts)


def test_pii_keeps_the_base_spans(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, SF_DIR).collect()}
    for d, text in texts:
        base = base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert got[d]["n_email"] == sum(k == "email" for k, _, _ in base)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[d]["spans"].split(","))


def test_language_of_the_held_out_fold(spark):
    got = QUERIES["op10_language_id"](spark, SF_DIR)
    rows = got.join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline_equals_its_plain_version(spark, texts):
    import corpus_pipeline

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    seen, kept = set(), []
    for d, text in sorted(texts):
        norm = " ".join(text.split())
        if any(c.isalpha() for c in text) and norm not in seen:
            seen.add(norm)
            kept.append((d, text))
    components, _ = jaccard_classes(kept)
    kept = [(d, t) for d, t in kept if components[d] == d]
    leaked = {d for d, _ in contained_items(kept, items)}
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == [d for d, _ in kept if d not in leaked]
    assert {"text", "lang", "source", "n_chars", "ids"} <= set(got.columns)
