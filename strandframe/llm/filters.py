"""Row filters that decide on whole texts in batches and pass all columns on, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandframe.llm.words import slices


def kept(docs: DataFrame, decide: Callable[[list[str | None]], np.ndarray], text_col: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """The rows for which decide(texts) is true; it runs on executors, a slice of texts at a time."""
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([StructField(f.name, f.dataType) for f in plain.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", max_bytes):
            mask = decide(batch.column(at).to_pylist())
            yield batch.filter(pa.array(np.asarray(mask, bool)))

    return plain.mapInArrow(run, schema).toDF(*names)


def with_text(docs: DataFrame, text: F.Column, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with another text, and its length in code points where there is a column for it."""
    out = docs.withColumn(text_col, text)
    if length_col not in docs.columns:
        return out
    return out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
