"""What the operators of this subpackage share: stages kept in the shared folder, document maps over Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.operators.graph import components, is_small, join_skewed  # noqa: F401  used through this module
from bidloom.session import ship
from bidloom.stages import keep, new_path, remove  # noqa: F401  used through this module


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def give_back() -> None:
    """Return to the system what a task of Python has freed: workers are used again, and would hold it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, whose task returns what it freed once it has given its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def map_documents(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    added: T.StructType,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add columns to documents, one Arrow batch at a time.

    make() runs once in each task and returns the function from a batch to the added columns. carry: the columns of docs to
    return, all by default. A column of docs that has the name of an added one is replaced.
    """
    ship(docs.sparkSession)
    taken = {f.name.lower() for f in added}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    schema = T.StructType([docs.schema[c] for c in carry] + list(added))
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = work(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(new[n] for n in names)], names=[*carry, *names])

    return docs.mapInArrow(giving_back(run), schema)


def semi_join(left: DataFrame, right: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Rows of left with a partner in right, a kept table of keys: broadcast up to `most` rows, shuffled beyond."""
    return left.join(F.broadcast(right) if is_small(right, most) else right, on, "left_semi")
