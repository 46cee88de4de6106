"""A corpus made ready for training: five stages over `documents`, each written as Parquet and reread by the next.

1. toxicity: documents that score 0.5 or more go;
2. line dedup: lines equal or within one edit of an earlier line go, and documents that have no word left after that;
3. SimHash near-dedup: of each component the document with the smallest id stays;
4. benchmark decontamination: documents that hold a window of a benchmark item go;
5. best-fit packing: the rest, as token pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import decontaminate, linededup, packing, simhash, toxicity
from bidloom.llm.common import keep
from bidloom.llm.queries import tokenizer_path
from bidloom.session import table


def _short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Documents go to Python by so many rows at most: Spark's default of 10,000 whole texts would lie in JVM and Python buffers at once. Set for
    the session, since a stage's frame runs after the stage's function returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).where("score < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(docs).where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return done.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else c for c, t in docs.dtypes])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return decontaminate.clean(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), carry=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can express neither the scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
