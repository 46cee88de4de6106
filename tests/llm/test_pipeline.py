"""The stages of the pipeline, each on the rows that its predecessor kept."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from bidloom.llm import common, simhash, toxicity
from bidloom.llm.common import keep
from bidloom.session import table
from tests.llm.test_operators import brute_components, brute_hits, brute_lines, brute_print

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    columns, rows = docs.columns, []
    for name, stage in P.STAGES:
        rows.append(docs.toPandas().sort_values("doc_id"))
        docs = keep(stage(spark, docs, D), "t")
        assert docs.columns == columns or name == "best-fit packing"
    start, calm, lines, single, clean = rows
    model = toxicity.learn(table(spark, D, "documents"), table(spark, D, "labels"))
    scores = toxicity.toxicity(table(spark, D, "documents"), model).toPandas().set_index("doc_id").score
    assert set(calm.doc_id) == set(scores[scores < 0.5].index) and len(calm) < len(start)
    texts = brute_lines(list(zip(calm.doc_id, calm.text)))
    assert dict(zip(lines.doc_id, lines.text)) == {k: t for k, t in texts.items() if t.split() or t == calm.set_index("doc_id").text[k]}
    assert (lines.n_chars == lines.text.str.len()).all()
    prints = {k: brute_print(t) for k, t in zip(lines.doc_id, lines.text)}
    assert set(single.doc_id) == set(brute_components(prints).values())
    items = [(r.item_id, r.text) for r in table(spark, D, "benchmark").collect()]
    assert set(clean.doc_id) == {k for k, t in zip(single.doc_id, single.text) if not brute_hits(t, items)[1]}
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(clean.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run(spark):
    assert P.run(spark, D).count() > 0


def test_python_gets_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        P.drop_near_duplicates(spark, table(spark, D, "documents").limit(3), D)
        rows = spark.range(5_000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert rows.agg(F.max("n")).first()[0] <= 1_000
    finally:
        spark.conf.set(name, before)


def test_tasks_give_back_what_they_freed(spark, monkeypatch):
    docs, tasks = table(spark, D, "documents"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: tasks.append(work) or real(self, work, schema))
    model = toxicity.learn(docs, table(spark, D, "labels"))
    toxicity.toxicity(docs.select("doc_id", "text"), model)
    simhash.link(spark.createDataFrame([(1,)], "fingerprint long"))
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    assert [b.num_rows for b in tasks[3](iter([batch, batch]))] == [2, 2] and done == [1]
    for k, task in enumerate(tasks):
        list(task(iter([])))
        assert len(done) == k + 2
    assert len(tasks) == 6
