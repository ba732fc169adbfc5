"""Sequential steps over the rows of each key, in order, with a state of fixed size.

Rows are dealt by key and sorted within partitions, which may spill, and pass through a function one after the other; what
it returns for a row is sent on at once.  So a key's rows never have to be held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[tuple], tuple]


def in_order(rows: DataFrame, keys: list[str], order: list[Column], values: list[str], start: Callable[[], Step], returned: str) -> DataFrame:
    """``keys`` and what each row gives: ``start()`` makes the function for a key, which gets ``values`` of its rows in order.

    ``returned`` names the columns that the function's tuples hold.  Keys may be null.
    """
    sent = rows.select(*keys, *[F.col(v).alias(f"_v{k}") for k, v in enumerate(values)], *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    sorted_ = sent.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{k}" for k in range(len(order))])
    n_keys = len(keys)
    out = StructType([*sent.select(*keys).schema.fields, *StructType.fromDDL(returned).fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            names = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True))
            results = []
            for key, row in zip(names, zip(*(c.to_pylist() for c in batch.columns[n_keys:]), strict=True), strict=True):
                if step is None or key != current:
                    current, step = key, start()
                results.append(step(row))
            columns = list(zip(*results, strict=True)) if results else [[] for _ in range(len(schema) - n_keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[n_keys:], strict=True))], schema=schema)

    return sorted_.select(*keys, *[f"_v{k}" for k in range(len(values))]).mapInArrow(run, out)
