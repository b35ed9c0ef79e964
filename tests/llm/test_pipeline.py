import random

import pytest
from test_near_dup import brute as components
from test_quality_rules import brute as measures

import corpus_pipeline
from skilltrail.llm.decontamination import benchmark_hits
from skilltrail.llm.quality_model import fitted, scored
from skilltrail.llm.training import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(2000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(words(30))) for i in range(4)]
    rows, labels = [], []
    for i in range(400):
        text, label = " ".join(words(rng.randint(25, 90))), 1
        kind = i % 10
        if kind == 1:
            text, label = "!! ".join(w.upper() for w in words(50)), 0
        elif kind == 2:
            text = " ".join(words(8)) + " " + " ".join(words(8) * 6)
        elif kind == 3 and i > 13:
            text = rows[i - 10][1] + " one more"
        elif kind == 4 and i % 3 == 0:
            text += " " + items[i % 4][1] + " " + " ".join(words(9))
        elif kind == 5:
            text = rng.choice([None, "", "few words", text])
        rows.append((i, text, None, f"src{i % 5}", len(text or ""), "x"))
        if i % 2:
            labels.append((i, label))
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + rows[:3], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def after(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    network = fitted(docs, labels.where(fold(labels.doc_id, 5) != 0))
    good = {r.doc_id for r in scored(docs, network).collect() if r.score >= 0.3}
    first = after("quality_model", docs)
    assert {r.doc_id for r in first.collect()} == good
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any((texts[n] or "").isupper() for n in good)

    second = after("quality_rules", first)
    passed = {n for n in good if not measures(texts[n])[5]}
    assert {r.doc_id for r in second.collect()} == passed

    third = after("near_dup", second)
    rows = [(n, texts[n]) for n in sorted(passed)]
    assert {r.doc_id for r in third.collect()} == {c for _, _, c in components(rows, 5)}

    fourth = after("decontamination", third)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    hit = {r.doc_id for r in benchmark_hits(third, bench).collect()}
    items = [r.text for r in bench.collect()]
    assert {n for n in (r.doc_id for r in third.collect()) if any(i in texts[n] for i in items)} <= hit
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - hit

    packed = after("packing", fourth).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in fourth.collect()}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed
    )


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
    assert corpus_pipeline.packing(spark, docs, folder).collect() == []
