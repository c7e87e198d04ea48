from __future__ import annotations

import random

import corpus_pipeline
import pytest
from brute import near_groups
from pyspark.sql import functions as F
from test_text import toxic_rows

from tessitura.llm import decontaminate, exact_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t) for i, t, _ in toxic_rows(400)]
    clean = [t for i, t, y in toxic_rows(400) if not y]
    item = " ".join(clean[3].split()[:15])
    extra = [(1000, clean[0] + " "), (1001, clean[0]), (1002, clean[1] + " another"), (1003, item), (1004, None)]
    docs = [(i, t, "en", f"src{random.Random(i).randint(0, 3)}", len(t or "")) for i, t in rows + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_is_judged_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= kept[-1]
        if name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_dedup(before).where("kept").collect()}
        if name == "near_dedup":
            assert ids == {d for d, (_, _, keep) in near_groups([(r.doc_id, r.text) for r in before.collect()]).items() if keep}
        if name == "decontaminate":
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert ids == {r.doc_id for r in decontaminate.decontaminate(before, bench).where(~F.col("contaminated")).collect()}
        kept.append(ids)
    clean = {i for i, _, y in toxic_rows(400) if not y}
    assert len(kept[1] & clean) >= 0.97 * len(clean) and 1003 not in kept[-1] and 1001 not in kept[-1] and 1004 in kept[-1]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 200


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choice("abdeghinorstw") for _ in range(r.randint(2, 8))) for _ in range(300)]
    a, b, c, d, e, item = (" ".join(r.choice(words) for _ in range(60)) for _ in range(6))
    near = " ".join([*d.split()[:-1], "other"])
    rows = [(1, a), (None, a), (2, b), (2, b), (None, c), (None, c), (3, d), (3, e), (None, near), (4, e), (None, item), (5, item), (5, "clean " + c[::-1])]
    made = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def left(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def pairs(docs):
        return sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)

    exact = left("exact_dedup", docs)
    assert pairs(exact) == sorted([(1, a), (2, b), (None, c), (3, d), (3, e), (None, near), (5, item), (5, "clean " + c[::-1])], key=str)
    deduped = left("near_dedup", exact)
    assert pairs(deduped) == sorted([(1, a), (2, b), (None, c), (3, d), (3, e), (5, item), (5, "clean " + c[::-1])], key=str)
    assert pairs(left("decontaminate", docs)) == sorted([x for x in rows if x[1] != item], key=str)
