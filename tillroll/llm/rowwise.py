"""Per-document functions over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.llm.arrays import text_slices

SliceFunction = Callable[[np.ndarray, np.ndarray], list]


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers of this session import the package even if it is not installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    here = spark.sparkContext.environment
    paths = here.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        here["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def with_text_columns(
    docs: DataFrame, fn: SliceFunction, fields: Sequence[T.StructField], text_col: str, keep: Sequence[str]
) -> DataFrame:
    """Columns `keep` and what `fn` makes of the texts.

    `fn` gets a slice as (bytes, offsets) and returns one value list per field.
    `keep` may hold the text itself. Other columns are left behind.
    """
    workers_can_import(docs.sparkSession)
    carried = list(dict.fromkeys(keep))
    source = docs.select(*carried, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in carried), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last, data, offsets in text_slices(texts):
                part = batch.slice(first, last - first)
                made = fn(data, offsets)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(carried))]
                columns += [
                    m if isinstance(m, pa.Array) else pa.array(m, arrow.field(len(carried) + i).type)
                    for i, m in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)
