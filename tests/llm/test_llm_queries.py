"""The registered queries and the pipeline on the smallest supplied tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from compare import connect, difference
from conftest import SF_SMALL
from test_llm_operators import plain_base, similarity, simulate

import corpus_pipeline
from newsloom.llm import bpe, mixing, toxicity
from newsloom.llm.common import table
from newsloom.llm.queries import ORACLE, QUERIES

SF_LABELLED = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, SF_SMALL)
    key = "page_id" if "page_id" in rows.columns else "doc_id"
    source = table(spark, SF_SMALL, "pages" if key == "page_id" else "documents")
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in source.select(key).collect())


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, SF_SMALL).collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, SF_SMALL, "labels").collect()}
    clean = [i for i, m in marks.items() if not m and got[i].held_out]
    assert sum(got[i].predicted for i in clean) <= 0.02 * len(clean)


def test_toxicity_catches_held_out_toxic_documents(spark):
    """On tables with enough labels. About one toxic label in seven there marks a text without any insult."""
    held = QUERIES["op6_toxicity"](spark, SF_LABELLED).where("held_out").join(table(spark, SF_LABELLED, "labels"), "doc_id")
    pairs = Counter((r.toxic, r.predicted) for r in held.select("toxic", "predicted").collect())
    assert pairs[1, 1] >= 0.8 * (pairs[1, 0] + pairs[1, 1]) > 0
    assert pairs[0, 1] <= 0.005 * (pairs[0, 0] + pairs[0, 1])


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF_SMALL, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        kept.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    source = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    labels = table(spark, SF_SMALL, "labels")
    score = toxicity.fit(table(spark, SF_SMALL, "documents"), labels).scorer()
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(i for i, t in source.items() if score(t) < 0.5)

    texts = {r["doc_id"]: r["text"] for r in kept[0]}
    parent = {i: i for i in texts}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(texts[a]) * 2 > len(texts[b]) and len(texts[b]) * 2 > len(texts[a]) and similarity(texts[a], texts[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in kept[1]) == sorted({find(i) for i in ids})

    assert [r["doc_id"] for r in sorted(kept[2], key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in kept[1])
    for row in kept[2]:
        assert not plain_base(row["text"]) and row["n_chars"] == len(row["text"])
        if not plain_base(texts[row["doc_id"]]) and "[SECRET]" not in row["text"]:
            assert row["text"] == texts[row["doc_id"]]

    sizes = Counter(r["source"] for r in kept[2])
    total = sum(n**mixing.EXPONENT for n in sizes.values())
    weights = {s: max(1, round(n**mixing.EXPONENT / total * mixing.ROUND)) for s, n in sizes.items()}
    slots = simulate(sizes, weights, mixing.BLOCK_ROWS)
    got = defaultdict(set)
    for row in kept[3]:
        got[row["source"]].add(row["mix_slot"])
    assert {s: sorted(v) for s, v in got.items()} == {s: [slots[s, b] for b in range(len(got[s]))] for s in got}

    enc = bpe.encoding()
    masked = {r["doc_id"]: r["text"] for r in kept[3]}
    assert len(kept[4]) == len(masked)
    for row in kept[4]:
        assert row["n_tokens"] == len(enc.encode_ordinary(masked[row["doc_id"]]))
        assert row["decoded_sha256"] == hashlib.sha256(masked[row["doc_id"]].encode()).hexdigest()
    assert not re.search("text", ",".join(kept[4][0]))
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(kept[4])
