"""Whole conversations through Python tasks, one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import common as c


def by_conversation(rows: DataFrame, order: Sequence[Column], solve: Callable[[list[dict]], Sequence], out: Sequence[tuple[str, T.DataType]], size: int = 4_000_000) -> DataFrame:
    """(conv, *out): ``solve`` gets the rows of each ``conv`` in ``order`` and returns the values of its one row.

    Rows go to their conversation's partition and are sorted there by Spark,
    which spills; a task holds one conversation in Python.  The rows with a
    null ``conv`` are one conversation.
    """
    dealt = rows.repartition("conv").sortWithinPartitions("conv", *order)
    schema = c.struct(("conv", c.column_type(rows, "conv")), *out)
    names = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        held: list[dict] = []
        done: list[tuple] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, arrow)], names=schema.names)
        for b in c.small(batches, "text"):
            if arrow is None:
                from pyspark.sql.pandas.types import to_arrow_schema
                arrow = to_arrow_schema(schema)
            for values in zip(*(b.column(n).to_pylist() for n in names)):
                row = dict(zip(names, values))
                if held and held[0]["conv"] != row["conv"]:
                    done.append((held[0]["conv"], *solve(held)))
                    held = []
                    if weight > size:
                        yield batch()
                        weight = 0
                held.append(row)
                weight += len(row["text"]) + 100
        if held:
            done.append((held[0]["conv"], *solve(held)))
            yield batch()
    return dealt.mapInArrow(task, schema)
