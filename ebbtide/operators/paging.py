"""Folds over the rows of one page, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_pages(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """fold(the sorted rows of a page, as tuples, key first) for every page; pages come one after the other in sorted partitions.

    One page is held at a time beside a batch, so memory is bounded by the largest page. Null keys are one page; a null
    floating number is NaN, which compares. dealt: the rows of a page already share a partition.
    """
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(made)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page = None, []
        for batch in batches:
            out = []
            columns = [(pc.fill_null(c, float("nan")) if pa.types.is_floating(c.type) else c).to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if page and row[0] != now:
                    out += fold(page)
                    page = []
                now = row[0]
                page.append(row)
            yield batch_of(out)
        if page:
            yield batch_of(fold(page))

    columns = [key, *(c for c in rows.columns if c != key)]
    placed = rows if dealt else rows.repartition(key)
    return placed.sortWithinPartitions(key, *order).select(columns).mapInArrow(run, schema)
