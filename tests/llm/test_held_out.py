"""Held-out figures of the toxicity classifier on the labelled test table, whose labels are noisy: some toxic texts hold no sign at all."""

from __future__ import annotations

import os

import pytest

from tessitura.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/labels.parquet"), reason="needs the test tables")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert all(model.toxic) and all(model.ordinary) and len(model.ground) > 100_000
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(docs["doc_id"]))
    scores = toxicity.score(held, model).join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r.score for r in scores if r.toxic == y] for y in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    caught = sum(r.predicted for r in scores if r.toxic)
    flagged = sum(r.predicted for r in scores)
    print(f"auc {auc:.3f}, recall {caught} of {len(toxic)}, precision {caught} of {flagged}, {len(clean)} clean")
    assert auc > 0.72 and caught > 0.4 * len(toxic) and caught > 0.85 * flagged
