"""Shared helpers of the vector operators: usable rows, matrices of a batch, bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (as double and as stored) of rows whose id and every component are there and finite."""
    kept = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("embedding"), *([rows["label"].cast("long").alias("label")] if "label" in rows.columns else []))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch, one a row; shorter ones are filled up with zeros."""
    flat, off = np.asarray(column.flatten()), np.asarray(column.offsets)
    size = np.diff(off)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def sampled(rows: DataFrame, total: int, most: int, width: int) -> np.ndarray:
    """About ``most`` vectors, chosen by a hash of their ids and the same in every run; twice as many at most."""
    share = min(1 << 30, int((1 << 30) * most / max(total, 1)))
    part = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) < share).limit(2 * most).select("vec_id", "embedding").toArrow().combine_chunks()
    if not part.num_rows:
        return np.empty((0, width))
    order = np.argsort(np.asarray(part["vec_id"]), kind="stable")
    return matrix(pa.concat_arrays(part["embedding"].chunks), width)[order]
