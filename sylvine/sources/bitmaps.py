"""Sets of ids in the portable roaring format, with or without the state wrapper of a column store."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the format: cookies of sets without and with run containers.
PLAIN, RUNS, NO_OFFSETS = 12346, 12347, 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def from_state(data: bytes) -> np.ndarray:
    """Ids of an aggregate state: a small form with bare ids, or a large one around a portable set."""
    if data[0] == 0:
        return np.unique(np.frombuffer(data, "<u4", data[1], 2).astype(np.int64))
    size, at = _varint(data, 1)
    return from_portable(data[at : at + size])


def from_portable(data: bytes) -> np.ndarray:
    """Sorted ids of a portable roaring set."""
    cookie = struct.unpack_from("<I", data)[0]
    if cookie & 0xFFFF == RUNS:
        n, at = (cookie >> 16) + 1, 4 + ((cookie >> 16) + 8) // 8
        is_run = np.unpackbits(np.frombuffer(data, np.uint8, at - 4, 4), bitorder="little")[:n].astype(bool)
    elif cookie == PLAIN:
        n, at = struct.unpack_from("<I", data, 4)[0], 8
        is_run = np.zeros(n, bool)
    else:
        raise ValueError("not a portable set")
    head = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if cookie == PLAIN or n >= NO_OFFSETS:
        at += 4 * n
    parts = [np.zeros(0, np.int64)]
    for (key, last), run in zip(head.tolist(), is_run.tolist(), strict=True):
        count = last + 1
        if run:
            m = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * m, at + 2).reshape(m, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs.tolist()])
            at += 2 + 4 * m
        elif count > 4096:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        else:
            low = np.frombuffer(data, "<u2", count, at).astype(np.int64)
            at += 2 * count
        parts.append(low + (key << 16))
    return np.concatenate(parts)


def to_portable(ids: np.ndarray) -> bytes:
    """A portable set of ids, in array and bit-set containers."""
    ids = np.unique(np.asarray(ids, np.int64))
    keys, first = np.unique(ids >> 16, return_index=True)
    parts = np.split(ids & 0xFFFF, first[1:]) if len(keys) else []
    bodies = [np.packbits(np.isin(np.arange(65536), p), bitorder="little").tobytes() if len(p) > 4096 else p.astype("<u2").tobytes() for p in parts]
    head = b"".join(struct.pack("<HH", k, len(p) - 1) for k, p in zip(keys.tolist(), parts, strict=True))
    begin = 8 + 8 * len(parts)
    offsets = np.cumsum([0] + [len(b) for b in bodies])[:-1] + begin
    return struct.pack("<II", PLAIN, len(parts)) + head + offsets.astype("<u4").tobytes() + b"".join(bodies)


def ids(states: DataFrame, column: str = "state") -> DataFrame:
    """Rows doc_id: the ids of all the sets in a column of state or portable bytes, each once; nulls hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if data.is_valid:
                    raw = data.as_buffer().to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array(from_state(raw) if raw[0] < 2 else from_portable(raw))], ["doc_id"])

    return states.select(column).mapInArrow(run, "doc_id long").distinct()


def packed(column: str | Column) -> Column:
    """State bytes of a column of id lists: the small form up to 32 ids, else a portable set with its size before it."""

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else to_state(np.asarray(x, np.int64)))

    return run(column)


def to_state(values: np.ndarray) -> bytes:
    values = np.unique(values)
    if len(values) <= 32:
        return bytes([0, len(values)]) + values.astype("<u4").tobytes()
    body, size = to_portable(values), b""
    n = len(body)
    while n >= 0x80:
        size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
    return b"\x01" + size + bytes([n]) + body
