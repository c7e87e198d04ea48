"""Nulls, repeats, empty and very long texts, ties, empty tables and clashing columns: every operator has a defined result."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text import VOCABULARY, brute_contaminated

from tessitura.llm import bpe, common, decontaminate, exact_dedup, licenses, minhash, pii, suffix_repeats, token_counts, toxicity

assert public_tokenizers
r = random.Random(21)
WORDS = ["".join(r.choice("abdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
LONG = " ".join(r.choice(WORDS) for _ in range(60_000))
TEXT = " ".join(r.choice(WORDS) for _ in range(80))
ROWS = [(1, None), (2, ""), (3, " \n"), (4, TEXT), (4, TEXT), (4, TEXT + " more"), (None, TEXT), (None, None), (5, LONG), (6, LONG), (7, "Released under the MIT License. a@b.cd"), (7, "x")]
#: names that the operators use themselves
EXTRA = {"sha": "s", "gram": "g", "norm": "n", "_row": "q", "key": "k", "digest": "d", "doc": "e", "w": "f", "score": "h", "id": "i", "n": "j", "seq": "l"}


def table(spark, rows=tuple(ROWS)):
    docs = spark.createDataFrame(list(rows), "doc_id long, text string")
    return docs.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def bench(spark):
    return spark.createDataFrame([(1, " ".join(TEXT.split()[:20])), (1, " ".join(TEXT.split()[:20])), (None, "mit license"), (2, None)], "item_id long, text string")


MODEL = toxicity.Model((b"",), (b"",), b"", (-2.0,) + (0.0,) * 7)
OPERATORS = {
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
    "toxicity": lambda spark, d: toxicity.score(d, MODEL),
    "near": lambda spark, d: minhash.near_dedup(d),
    "decontaminate": lambda spark, d: decontaminate.decontaminate(d, bench(spark)),
    "encode": lambda spark, d: bpe.encode(d, VOCABULARY),
    "pii": lambda spark, d: pii.find_personal_data(d),
    "repeats": lambda spark, d: suffix_repeats.remove_repeats(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](spark, table(spark, ())).collect() == []
    if name == "exact":
        assert {(x.doc_id, x.keep_id, x.group_size) for x in got if x.doc_id in (1, 2, None)} == {(1, 1, 3), (2, 1, 3), (None, 1, 3), (None, 4, 3)} - {(2, 1, 3)} | {(2, 1, 3)}
        assert {(x.doc_id, x.keep_id) for x in got if x.doc_id in (5, 6)} == {(5, 5), (6, 5)}
    if name == "near":
        assert {(x.doc_id, x.component_id) for x in got if x.doc_id in (4, 5, 6)} == {(4, 4), (5, 5), (6, 5)}
        assert {x.component_id for x in got if x.doc_id is None} == {4, None}
    if name == "decontaminate":
        want = sorted(brute_contaminated([(k, t) for k, (_, t) in enumerate(ROWS)], [(x.item_id, x.text) for x in bench(spark).collect()]).values())
        assert sorted((x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
    if name == "repeats":
        assert {(x.doc_id, x.n_bytes - x.n_removed) for x in got if x.doc_id in (5, 6)} == {(5, len(LONG)), (6, 0)}


def test_rows_of_sections_and_notices(spark):
    sections = token_counts.token_counts(table(spark), VOCABULARY).collect()
    assert sum(x.section == 0 for x in sections) == len(ROWS) and token_counts.token_counts(table(spark, ()), VOCABULARY).collect() == []
    assert [(x.doc_id, x.license) for x in licenses.scan_licenses(table(spark)).collect()] == [(7, "MIT")]
    assert suffix_repeats.repeat_groups(table(spark, ())).collect() == []
    groups = suffix_repeats.repeat_groups(table(spark, ROWS[:8])).groupBy("repeat").agg(F.collect_list("doc_id"), F.count("*").alias("n")).collect()
    assert [x.n for x in groups] == [4]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", ROWS), ("none", [])):
        folder = f"{tmp_path}/{name}"
        table(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 0), (5, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        bench(spark).write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, folder).write.parquet(f"{folder}/{step}")
            assert spark.read.parquet(f"{folder}/{step}").columns == docs.columns
            docs = spark.read.parquet(f"{folder}/{step}")
        assert docs.count() == corpus_pipeline.run(spark, folder).count() == (4 if rows else 0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.scratch_root(Session())
