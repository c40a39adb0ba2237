"""Arrow batches in, Arrow batches out: the frame around the operators' per-batch work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Made = list[Iterable]


#: Rows that are Python objects at the same time.
ROWS = 2_048


def made_columns(frame: DataFrame, inputs: list[str], made: str, f: Callable[..., Made], keep: list[str] | None = None, lists: bool = True) -> DataFrame:
    """``frame`` with the columns of the DDL ``made``, which ``f`` computes from lists of ``inputs``.

    ``f`` gets one Python list per input column (``lists=False``: an Arrow array) and returns one list
    or Arrow array per new column, for at most ``ROWS`` rows at a time.
    ``keep`` names the columns to carry along (default: all); one that has the name of a made
    column is replaced by it. The step is a barrier: later filters never run ``f`` a second time.
    """
    new = T.StructType.fromDDL(made)
    taken = {x.name.lower() for x in new}
    kept = [c for c in (frame.columns if keep is None else keep) if c.lower() not in taken]
    # an input that is carried along as well travels once
    places = [kept.index(c) if c in kept else None for c in inputs]
    given = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(inputs) if places[i] is None]
    n = len(given)
    at_input = [n + x if x is not None else sum(y is None for y in places[:i]) for i, x in enumerate(places)]
    source = frame.select(*given, *(F.col(f"`{c}`").alias(f"out_{i}") for i, c in enumerate(kept)))
    schema = T.StructType([*source.schema.fields[n:], *new.fields])
    names, arrow = schema.names, [to_arrow_type(x.dataType) for x in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = f(*(batch.column(i).to_pylist() if lists else batch.column(i) for i in at_input))
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[n:], *arrays], names=names)

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"out_{i}").alias(c) for i, c in enumerate(kept)), *new.names)



def numbered(frame: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``frame`` under names that no operator makes, the new name of each column, and the way back."""
    names = {c: f"given_{i}" for i, c in enumerate(frame.columns)}
    back = [F.col(new).alias(c) for c, new in names.items()]
    return frame.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items())), names, back


#: Rows of a join side that are read to the driver and broadcast from there.
MAX_BROADCAST = 100_000


def few(side: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A join side, broadcast if it turns out to have at most ``most`` rows.

    It is evaluated here, so the other side need not be shuffled to find out. A larger side is left
    to be joined by a shuffle.
    """
    rows = side.limit(most + 1).collect()
    return F.broadcast(side.sparkSession.createDataFrame(rows, side.schema)) if len(rows) <= most else side
