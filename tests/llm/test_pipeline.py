"""The pipeline's stages, one after the other, on whole small tables."""

import corpus_pipeline
from skytally.llm import packing, queries
from skytally.llm.common import table
from tests.llm.test_near_dup import sets_of


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.documents(spark, folder)
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] and kept[3] < kept[2]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    rows = docs.collect()
    assert sum(labels.get(r["doc_id"], 1) == 0 for r in rows) < 0.4 * sum(v == 0 for v in labels.values())
    sets = [sets_of(r["text"]) for r in rows]
    for i, a in enumerate(sets):
        for b in sets[i + 1:]:
            assert not a or 100 * len(a & b) < 80 * len(a | b)
    stage = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert stage.select("doc_id").distinct().count() == len(rows)
    assert [f.name for f in stage.schema] == [c.split()[0] for c in packing.PLACED.split(", ")]


def test_empty_and_odd(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2)],
                                 "doc_id long, text string, lang string, source string, n_chars long, component int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        assert stage(spark, docs, folder).count() <= 3
