"""Byte strings packed by length: a row holds many strings of one length, end to end.

The batch hash functions work on all strings of one length at once, so a stream that is read
again and again goes from its files to them as whole matrices, not as a row for each string.

Defined cases: nulls are packed as a number of nulls without bytes; repeated strings stay
repeated; an empty stream gives no rows; a string longer than ``PIECE`` is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hashloom.functions.families import loaded
from hashloom.sources.shared import written

SCHEMA = "size int, n long, data binary"
#: Bytes of strings that a task holds before it sends them, of a row, and of a row group; a
#: string counts as eight at least.
HELD, PIECE, GROUP = 8 << 20, 1 << 16, 8 << 20


def _rows(held: dict[int | None, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The matrices of each length as one, cut into pieces; length None: only their number."""
    for size, parts in held.items():
        whole, step = np.concatenate(parts), max(1, PIECE // max(size or 0, 8))
        for at in range(0, len(whole), step):
            piece = whole[at : at + step]
            columns = [pa.array([size], pa.int32()), pa.array([len(piece)], pa.int64()), pa.array([None if size is None else piece.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "n", "data"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = {}, 0
    for batch in batches:
        keys = batch.column(0)
        parts = [(m.shape[1], m) for _, m in loaded(keys.drop_null())[1]]
        if keys.null_count:
            parts.append((None, np.zeros((keys.null_count, 0), np.uint8)))
        for size, m in parts:
            held.setdefault(size, []).append(m)
            total += len(m) * max(size or 0, 8)
        if total >= HELD:
            yield from _rows(held)
            held, total = {}, 0
    yield from _rows(held)


def packed(stream: DataFrame, key: str) -> DataFrame:
    """(size, n, data) of all strings of a BINARY column, as a table in the shared folder."""
    return written(stream.select(key).mapInArrow(_pack, SCHEMA), "packed", **{"parquet.block.size": GROUP})


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
    """(number, byte matrix) of each row of a batch; no matrix: so many nulls."""
    for size, n, data in zip(*batch.columns, strict=True):
        yield n.as_py(), np.frombuffer(data.as_buffer(), np.uint8).reshape(n.as_py(), size.as_py()) if data.is_valid else None
