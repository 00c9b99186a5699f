"""Projection of vectors to fewer dimensions by a sparse random matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvine.functions.forest import sparse_projection


def projected(corpus: DataFrame, dim_in: int, dim_out: int, seed: int = 0) -> DataFrame:
    """(id, vec) with vec in dim_out dimensions; inner products are kept on average. The matrix is bounded by its dimensions."""
    matrix = sparse_projection(dim_in, dim_out, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, dim_in) @ matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * dim_out), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "vec"])

    return corpus.select("id", "vec").mapInArrow(run, "id long, vec array<double>")
