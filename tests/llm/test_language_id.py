import zlib

import numpy as np
import pyarrow as pa

from skilltrail.llm.language_id import GRAMS, WINDOWS, LanguageModel, fitted, gram_ids, op4_language_id, predicted
from skilltrail.llm.quality_model import text_bytes


def test_grams_do_not_depend_on_neighbours():
    texts = ["", "abc", "é abc", "x" * 400, "abc"]
    ids, bounds = gram_ids(*text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]]
        assert len(own) == len(text.encode()) * len(GRAMS)
        alone, _ = gram_ids(*text_bytes(pa.array([text])))
        assert own.tolist() == alone.tolist()


def test_odd_rows(spark):
    rows = [(i, "hello this is the text", "en") for i in range(40)] + [(i, "això és català ñ", "ca") for i in range(40, 80)]
    rows += [(80, None, "en"), (81, "", "en"), (82, "123 !? 4", None), (83, "hello the text", None), (83, "hello the text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fitted(docs.select("text", "lang"))
    found = predicted(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id in (80, 81, 82):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("ca" if 40 <= r.doc_id < 80 else "en")
            assert 0 <= r.score <= 1
    empty = docs.limit(0)
    assert predicted(empty, model).collect() == []
    nothing = fitted(empty.select("text", "lang"))
    assert {r.lang_pred for r in predicted(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op4_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    right = [found[d.doc_id].lang_pred == d.lang for d in docs if found[d.doc_id].held_out and d.lang]
    assert np.mean(right) > 0.97
    assert np.mean([found[d.doc_id].rejected for d in docs]) < 0.2


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    """100,000 copies of one text leave as many of a language's other texts as without them."""
    used = []
    for step in ("fit", "calibrate"):
        monkeypatch.setattr(LanguageModel, step, lambda self, ids, bounds, labels: used.extend(labels.tolist()))
    texts = spark.range(200).selectExpr("concat('text of number ', id, ' and some more') text", "'en' lang")
    copies = spark.range(100_000).selectExpr("'one text that was copied very often' text", "'en' lang")
    other = spark.range(30).selectExpr("concat('otro texto que va con el ', id) text", "'es' lang")
    model = fitted(texts.unionByName(copies).unionByName(other), sample=5)
    assert model.languages == ["en", "es"]
    assert [used.count(label) for label in (0, 1)] == [5 * WINDOWS] * 2
