"""Bounded samples of labelled rows for fitting, and the rows' shares by the checksum of their doc_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo `folds`; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)).cast("int")


def chosen(label: str, shares: dict) -> Column:
    """Whether sampled() takes a row of (doc_id, label), given the shares it returned."""
    if not shares:
        return F.lit(False)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)) < F.coalesce(F.try_element_at(share, F.col(label)), F.lit(0.0)) * _PARTS


def sampled(labelled: DataFrame, label: str, each: int, rows: int = 50_000, most_labels: int = 2_000) -> tuple[DataFrame, dict]:
    """About `each` rows of each label (all rows of a rarer one), chosen by a hash of doc_id, and each label's sampled share.
    With so many labels that this would be over `rows` in all, each label gets an equal part of `rows`. labelled has
    doc_id and the label, not null. More than most_labels labels are an error: a model of this kind would not hold them."""
    counts = labelled.groupBy(label).count().limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"column {label} has more than {most_labels} values")
    each = min(each, rows // max(1, len(counts)))
    shares = {r[0]: min(1.0, each / r[1]) for r in sorted(counts)}
    if not shares:
        return labelled.limit(0), shares
    return labelled.filter(chosen(label, shares)), shares


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a collected column as numpy arrays, without Python objects in between."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.flatten().to_numpy(zero_copy_only=False), np.asarray(chunk.offsets) - chunk.offsets[0].as_py()
        out += [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out
