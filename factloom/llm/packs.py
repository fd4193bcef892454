"""Documents in compressed packs, and word or hash lists dealt to owners.

A pack is a few megabytes of consecutive documents in one row.  Operators that must look something up for
each word send, from each pack, one compact list per owner instead of a row per word, and get one list back.
Packs are named by a digest of their content, so a pack that is made again after a loss has the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import text_rows

#: Bytes of text in a pack, at least one document.
PACK_BYTES = 4 << 20
#: Bytes of text for each owner of words, and the fewest owners.
OWNER_BYTES = 8 << 20
MIN_OWNERS = 32


#: Compression levels of packs, which travel whole, and of lists.
PACK_LEVEL, LIST_LEVEL = 6, 3


def dump(batch: pa.RecordBatch, level: int = LIST_LEVEL) -> bytes:
    """A batch as bytes, compressed unless the level is 0."""
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=level) if level else None
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


def groups(batches, size: int):
    """Yield (name, batch) of whole packs from batches of (id, text); the name is a digest of the content."""

    def named(held):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return hashlib.sha1(dump(batch, 0)).digest()[:12], batch

    held, n = [], 0
    for batch in batches:
        at = 0
        for i, x in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            n += x + 16
            if n >= size:
                held.append(batch.slice(at, i + 1 - at))
                yield named(held)
                held, n, at = [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield named(held)


def packer(size: int):
    """Batches of (id, text) to batches of (pack, blob)."""

    def run(batches):
        for name, batch in groups(batches, size):
            yield pa.record_batch([pa.array([name], pa.binary()), pa.array([dump(batch, PACK_LEVEL)], pa.binary())], ["pack", "blob"])

    return run


def rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return text_rows(docs, doc_id, text)[0]


def pack(rows_: DataFrame) -> DataFrame:
    """Rows (pack, blob); a blob holds whole documents."""
    return rows_.mapInArrow(packer(PACK_BYTES), "pack binary, blob binary")


def owners(total_bytes: int) -> int:
    return max(MIN_OWNERS, -(-total_bytes // OWNER_BYTES))


def deal(keys: np.ndarray, owners: int):
    """Sorted distinct 64-bit keys by owner: yields (owner, places among the keys).

    The owner comes from the upper half of a key, so the lower half is left to tell an owner's keys apart.
    """
    owner = ((keys >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    ids, begin = np.unique(owner[order], return_index=True)
    ends = [*begin[1:].tolist(), len(keys)] if len(keys) else []
    for o, a, b in zip(ids.tolist(), begin.tolist(), ends, strict=True):
        yield o, order[a:b]
