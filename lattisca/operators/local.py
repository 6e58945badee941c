"""Work on whole graphs in memory: a graph is bounded, so one shuffle by graph brings its rows together, and graphs are taken
one by one as they come. What is not bounded by a graph is done with joins instead."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that are gathered before they are handed on.
BATCH = 20_000


def by_graph(rows: DataFrame, of: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``of`` gets the rows of one graph, without the graph's name (the first column), and gives rows without it too;
    ``schema`` names what it gives, behind the name."""
    name = rows.columns[0]
    first = rows.schema[name]
    full = StructType([first, *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        names: list = []
        out: list[tuple] = []
        here, held, started = None, [], False

        def finish() -> None:
            found = of(held)
            names.extend([here] * len(found))
            out.extend(found)

        def batch() -> pa.RecordBatch:
            columns = [names, *zip(*out, strict=True)] if out else [[]] * len(target)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            names.clear()
            out.clear()
            return made

        for piece in batches:
            for graph, *row in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                if started and graph != here:
                    finish()
                    held.clear()
                    if len(out) >= BATCH:
                        yield batch()
                here, started = graph, True
                held.append(tuple(row))
        if started:
            finish()
        yield batch()

    return rows.repartition(name).sortWithinPartitions(name).mapInArrow(run, full)
