"""The pipeline against a brute-force version of its stages on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from vframe.llm import mixing, queries, simhash_dedup, toxicity
from vframe.llm.common import table, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    score = toxicity.Scorer(*toxicity.fit(docs, labels))
    toxic = {r["doc_id"] for r in docs.collect() if score(r["text"]) >= toxicity.THRESHOLD}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    by_text = {}
    for i, t in left.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        by_text[key] = max(i, by_text.get(key, i))
    prints = {i: simhash_dedup.fingerprint(left[i]) for i in sorted(by_text.values())}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[b] = min(group[a], group[b])
        if all(group[group[i]] == group[i] for i in group):
            break
    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(pieces.doc_id) == set(group.values())
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


@pytest.mark.skipif(not Path(DATA.replace("0.001", "0.1")).exists(), reason="the driver's tables aren't here")
def test_held_out_labels(spark):
    data = DATA.replace("0.001", "0.1")
    found = queries.op1_toxicity(spark, data).where("held_out").join(table(spark, data, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.05 * (n[0, 1] + n[0, 0])


def test_sequences_follow_the_mix_over_several_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "word " * (1 + i % 97 * (1 + i % 3)), "hot" if i % 4 else "b") for i in range(1500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7, "doc_id")
        docs = written(corpus_pipeline.mixing_stage(spark, docs, DATA).repartition(5, "doc_id"))
        place = {r["doc_id"]: (r["_slot"], r["_place"]) for r in mixing.mix(docs, mixing.tempered(docs)).collect()}
        pieces = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_task = {}
    for r in pieces:
        by_task.setdefault(r["sequence_id"] >> 33, []).append(place[r["doc_id"]])
    spans = [(min(x), max(x)) for _, x in sorted(by_task.items())]
    assert len(spans) > 1 and {r["doc_id"] for r in pieces} == set(place)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
