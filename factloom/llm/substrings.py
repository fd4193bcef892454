"""Exact substring deduplication by fixed-block anchors.

Blocks of ``ANCHOR`` words that don't overlap are the reference index; every rolling window of as many words
probes it.  A repeat of ``WINDOW`` >= 2 * ANCHOR - 1 words holds a whole reference block in each of its copies, so
only around hits can a repeat lie.  Each hit is extended by the windows of ``WINDOW`` words that hold it: those found
elsewhere too, by hashes of 128 bits, join up to maximal repeats.  A hit isn't compared with the other texts one by one, as a passage
of many copies would need all their pairs.  Hashes travel in one list per pack and owner, answers come back as bits.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packs
from .shared import text_bytes
from .wordhash import WHITE, Words, spread, starts_inside, text_chunks, unique_pairs, windows

ANCHOR = 18
WINDOW = 35
ASK = "owner int, pack binary, kind int, keys binary, flags binary"
ANSWER = "owner int, pack binary, kind int, bits binary"
_ASK = pa.schema([("owner", pa.int32()), ("pack", pa.binary()), ("kind", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary())])
_ANSWER = pa.schema([("owner", pa.int32()), ("pack", pa.binary()), ("kind", pa.int32()), ("bits", pa.binary())])


class _Pack:
    """Word hashes of all documents of a pack, one after the other."""

    def __init__(self, column: pa.Array, wide: bool = False):
        hashes, others, counts = [], [], []
        for _, _, data, offsets in text_chunks(column):
            w = Words(data, offsets, WHITE)
            hashes.append(w.hashes())
            if wide:
                others.append(w.hashes(other=True))
            counts.append(w.counts)
        self.other = np.concatenate(others) if others else np.zeros(0, np.uint64)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [0])]).astype(np.int64)

    def anchors(self):
        """Positions of rolling windows in rows long enough for a repeat, their hashes, and which are blocks."""
        at = starts_inside(self.first, ANCHOR)
        row = np.searchsorted(self.first, at, "right") - 1
        long = np.diff(self.first)[row] >= WINDOW
        at, row = at[long], row[long]
        return at, windows(self.h, ANCHOR)[at], (at - self.first[row]) % ANCHOR == 0

    def full(self, starts: np.ndarray):
        """The distinct full windows at these places as pairs of hashes, which one each place has, and how often they are there."""
        return unique_pairs(windows(self.h, WINDOW)[starts], windows(self.other, WINDOW)[starts])

    def around(self, live: np.ndarray) -> np.ndarray:
        """Starts of full windows that hold a live anchor in their first ANCHOR places."""
        n = len(self.h)
        near = spread(np.maximum(live - (ANCHOR - 1), 0), np.minimum(live, ANCHOR - 1) + 1, n)
        at = starts_inside(self.first, WINDOW)
        return at[near[at]]


def _bits(answers: pa.Table, kind: int, keys: np.ndarray, owners: int) -> np.ndarray:
    """The answered bit of each of the sorted distinct keys."""
    got = {o: b for o, k, b in zip(*(answers.column(c).to_pylist() for c in ("owner", "kind", "bits")), strict=True) if k == kind}
    out = np.zeros(len(keys), bool)
    for o, own in packs.deal(keys, owners):
        out[own] = np.unpackbits(np.frombuffer(got[o], np.uint8), count=len(own)).astype(bool)
    return out


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _anchor_keys(p: _Pack):
    at, h, block = p.anchors()
    keys, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    is_block = np.zeros(len(keys), bool)
    is_block[inverse[block]] = True
    return at, keys, inverse, is_block.astype(np.uint8) + 2 * (n > 1).astype(np.uint8)


def _ask_anchors(owners, size):
    def run(batches):
        for name, got in packs.groups(batches, size):
            _, keys, _, flags = _anchor_keys(_Pack(got.column(1)))
            # half a hash and the owner's share of the rest: enough to thin out, the full windows decide
            if rows := [(o, name, 0, keys[own].astype(np.uint32).tobytes(), flags[own].tobytes()) for o, own in packs.deal(keys, owners)]:
                yield _batch(rows, _ASK)

    return run


def _answer(kind: int):
    """For each listed key: is it known twice, and (for anchors) in the block index?"""

    def run(table: pa.Table) -> pa.Table:
        dtype = np.uint32 if kind == 0 else np.uint64
        lists = [np.frombuffer(x, dtype) for x in table.column("keys").to_pylist()]
        if kind:  # pairs of hashes
            pairs, lists = lists, [x[: len(x) // 2] for x in lists]
        flags = [np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist()]
        passed = table.column("kind").to_pylist()
        own = [i for i, k in enumerate(passed) if k == 0]
        bits: list = [table.column("flags")[i].as_py() for i in range(len(passed))]
        if own:
            keys = np.concatenate([lists[i] for i in own])
            if kind:
                keys, _, inverse, _ = unique_pairs(keys, np.concatenate([pairs[i][len(lists[i]) :] for i in own]))
            else:
                keys, inverse = np.unique(keys, return_inverse=True)
            f = np.concatenate([flags[i] for i in own])
            twice = np.bincount(inverse, 1 + (f >= 2), len(keys)) > 1
            if kind == 0:
                index = np.zeros(len(keys), bool)
                index[inverse[(f & 1) == 1]] = True
                twice &= index
            hit, at = twice[inverse], 0
            for i in own:
                bits[i] = np.packbits(hit[at : at + len(lists[i])]).tobytes()
                at += len(lists[i])
        return pa.table([table.column("owner"), table.column("pack"), table.column("kind"), pa.array(bits, pa.binary())], schema=_ANSWER)

    return run


def _ask_windows(owners):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for name, blob in zip(left.column("pack").to_pylist(), left.column("blob"), strict=True):
            p = _Pack(packs.load(blob.as_py()).column(1), wide=True)
            at, keys, inverse, _ = _anchor_keys(p)
            live = at[_bits(right, 0, keys, owners)[inverse]]
            starts = p.around(live)
            full, other, _, n = p.full(starts)
            mask = np.zeros(len(p.h), bool)
            mask[starts] = True
            for o, own in packs.deal(full, owners):
                rows.append((o, name, 0, full[own].tobytes() + other[own].tobytes(), (2 * (n[own] > 1)).astype(np.uint8).tobytes()))
            # where the candidates are goes along, and comes back with the answers
            rows.append((int.from_bytes(name[:4], "big") % owners, name, 1, b"", np.packbits(mask).tobytes()))
        return pa.Table.from_batches([_batch(rows, _ASK)] if rows else [], _ASK)

    return run


def _remove(owners, id_type):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob"):
            got = packs.load(blob.as_py())
            p = _Pack(got.column(1), wide=True)
            total = len(p.h)
            mask = next(b for k, b in zip(right.column("kind").to_pylist(), right.column("bits").to_pylist(), strict=True) if k == 1)
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=total))
            keys, _, inverse, _ = p.full(starts)
            gone = spread(starts[_bits(right, 0, keys, owners)[inverse]], WINDOW, total)
            removed = np.concatenate([[0], np.cumsum(gone)])[p.first]
            cols = {f.name: [] for f in schema}
            for k, t in enumerate(got.column(1).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                a, b = int(p.first[k]), int(p.first[k + 1])
                n = int(removed[k + 1] - removed[k])
                begin = end = ()
                if n:
                    own = np.concatenate([[False], gone[a:b], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    begin, end = edge[::2].tolist(), edge[1::2].tolist()
                    words = compress(words, (~gone[a:b]).tolist())
                for c, v in zip(("n_words", "n_removed", "starts", "ends", "kept"), (b - a, n, begin, end, b" ".join(words)), strict=True):
                    cols[c].append(v)
            cols["doc_id"] = got.column(0)
            out.append(pa.table({f.name: pa.array(cols[f.name], f.type) if f.name != "doc_id" else pa.chunked_array([cols["doc_id"]]) for f in schema}))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``starts``/``ends`` (removed spans of words), ``kept`` (UTF-8 bytes).

    Null or blank text has no words.  Repeated rows are documents of their own and so repeat each other; an
    empty table gives no rows; other columns are ignored.
    """
    n = packs.owners(text_bytes(docs, text))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = packs.rows(docs, doc_id, text)
    packed = packs.pack(rows)
    live = rows.mapInArrow(_ask_anchors(n, packs.PACK_BYTES), ASK).groupBy("owner").applyInArrow(_answer(0), ANSWER)
    asked = packed.groupBy("pack").cogroup(live.groupBy("pack")).applyInArrow(_ask_windows(n), ASK)
    found = asked.groupBy("owner").applyInArrow(_answer(1), ANSWER)
    out = packed.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(
        _remove(n, pa.int64() if kind == "bigint" else pa.string()),
        f"doc_id {kind}, n_words long, n_removed long, starts array<int>, ends array<int>, kept binary",
    )
    return out.withColumnRenamed("doc_id", doc_id)
