"""Benchmark decontamination with a full-text index per shard of training documents.

A shard is a run of whole documents of about a megabyte; its index holds every word.  All phrases of the benchmark whose words the
shard knows are searched backwards at once, located by sampled positions, compared word by word and merged into spans of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import FMIndex
from .shared import frugal, saved, text_column, text_rows
from .wordhash import NOT_ALNUM, Words, text_chunks

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents may carry; a larger benchmark is searched in blocks.
BLOCK_BYTES = 2 << 20
#: Words of a benchmark item that stay together; longer items are cut into pieces that share all windows at their edges.
PIECE_WORDS = 4096
SHARD_BYTES = 1 << 20


def pieces(batches):
    """(i, t) rows to rows of at most ``PIECE_WORDS`` lower-cased words of the same windows."""
    for batch in batches:
        ids, texts = [], []
        for a, b, data, offsets in text_chunks(batch.column(1)):
            w = Words(data, offsets, NOT_ALNUM, lower=True)
            for r in range(b - a):
                own = [w.data[x:y].tobytes() for x, y in zip(w.starts[w.first[r] : w.first[r + 1]].tolist(), w.ends[w.first[r] : w.first[r + 1]].tolist(), strict=True)]
                for at in range(0, max(1, len(own) - WINDOW + 1) if own else 0, PIECE_WORDS - WINDOW + 1):
                    ids.append(batch.column(0)[a + r])
                    texts.append(b" ".join(own[at : at + PIECE_WORDS]).decode())
        yield pa.record_batch([pa.array([x.as_py() for x in ids], pa.string()), pa.array(texts, pa.string())], ["i", "t"])


class Phrases:
    """The distinct windows of a block of items: word numbers (-1 behind a shorter one's end), lengths and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = sorted({i or "" for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        vocab: dict[bytes, int] = {}
        tables, owners = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)]
        hashes: list[int] = []
        for a, b, data, offsets in text_chunks(pa.array([t or "" for _, t in items], pa.string())):
            w = Words(data, offsets, NOT_ALNUM, lower=True)
            h = w.hashes()
            own = np.empty(len(h), np.int32)
            for k, (x, y) in enumerate(zip(w.starts.tolist(), w.ends.tolist(), strict=True)):
                word = w.data[x:y].tobytes()
                if (n := vocab.get(word)) is None:
                    n = vocab[word] = len(vocab)
                    hashes.append(int(h[k]))
                own[k] = n
            for r in range(b - a):
                x = own[w.first[r] : w.first[r + 1]]
                if len(x):
                    rows = np.lib.stride_tricks.sliding_window_view(x, WINDOW) if len(x) >= WINDOW else np.pad(x, (0, WINDOW - len(x)), constant_values=-1)[None]
                    tables.append(rows)
                    owners.append(np.full(len(rows), number[items[a + r][0] or ""]))
        self.table, which = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
        self.lengths = (self.table >= 0).sum(1)
        pair = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], 1), axis=0)
        self.owner = pair[:, 1]  # items of phrase k: owner[first[k] : first[k + 1]]
        self.first = np.searchsorted(pair[:, 0], np.arange(len(self.table) + 1))
        self.hashes = np.array(hashes, np.uint64)
        self.bytes = np.frombuffer(b"".join(vocab), np.uint8)
        self.cut = np.concatenate([[0], np.cumsum([len(x) for x in vocab])]).astype(np.int64)

    def search(self, words: Words):
        """(phrase, first word) of every occurrence within a row of the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.table) or not len(words.starts):
            return none, none
        vocab, inverse = np.unique(words.hashes(), return_inverse=True)
        at = np.minimum(np.searchsorted(vocab, self.hashes), len(vocab) - 1)
        symbol = np.append(np.where(vocab[at] == self.hashes, at + 2, -1), 0)  # the last one is for -1
        table = symbol[self.table]
        some = np.flatnonzero((table >= 0).all(1))
        if not len(some):
            return none, none
        row = words.row
        edge = np.flatnonzero(row[1:] != row[:-1]) + 1
        text, back = np.insert(inverse + 2, edge, 1), np.insert(np.arange(len(row)), edge, -1)
        index = FMIndex(text, len(vocab) + 2)
        lo, hi = index.ranges(table[some], self.lengths[some])
        n = np.maximum(hi - lo, 0)
        phrase = np.repeat(some, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        first = back[index.locate(rows)]
        same = self._same(words, phrase, first)
        return phrase[same], first[same]

    def _same(self, words: Words, phrase: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Do the words themselves agree, and not only their hashes?"""
        word = self.table[phrase]
        place = np.minimum(first[:, None] + np.arange(WINDOW), len(words.starts) - 1)
        key, inverse = np.unique(np.where(word >= 0, place * len(self.hashes) + word, -1), return_inverse=True)
        p, v = key // len(self.hashes), key % len(self.hashes)
        p[key < 0] = v[key < 0] = 0
        size = self.cut[v + 1] - self.cut[v]
        ok = size == words.ends[p] - words.starts[p]
        size = np.where(ok, size, 0)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = words.data[np.repeat(words.starts[p], size) + step] != self.bytes[np.repeat(self.cut[v], size) + step]
        ok &= np.bincount(np.repeat(np.arange(len(key)), size)[differ], minlength=len(key)) == 0
        ok |= key < 0
        return ok[inverse.reshape(word.shape)].all(1)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _find(phrases, place: int | None):
    def run(batches):
        own = phrases.value
        for batch in batches:
            column = text_column(batch, place)
            for a, b, data, offsets in text_chunks(column, SHARD_BYTES):
                w = Words(data, offsets, NOT_ALNUM, lower=True)
                phrase, at = own.search(w)
                spans: list[list] = [[] for _ in range(b - a)]
                found: list[set] = [set() for _ in range(b - a)]
                row = w.row[at]
                for r, p, x in zip(row.tolist(), phrase.tolist(), (at - w.first[row]).tolist(), strict=True):
                    spans[r].append((x, x + int(own.lengths[p])))
                    found[r].update(own.owner[own.first[p] : own.first[p + 1]].tolist())
                names = [{own.ids[x] for x in f} for f in found]
                cols = batch.slice(a, b - a)
                if "starts" in cols.schema.names:  # what earlier blocks of the benchmark have found
                    for k, (s, e, i) in enumerate(zip(*(cols.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)):
                        spans[k] += zip(s, e, strict=True)
                        names[k].update(i)
                merged = [_merged(x) for x in spans]
                new = {
                    "n_words": pa.array(w.counts, pa.int64()),
                    "starts": pa.array([[x for x, _ in s] for s in merged], pa.list_(pa.int32())),
                    "ends": pa.array([[x for _, x in s] for s in merged], pa.list_(pa.int32())),
                    "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                }
                keep = [c for c in cols.schema.names if c not in new]
                yield pa.record_batch([*[cols.column(c) for c in keep], *new.values()], [*keep, *new])

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text",
    whole_row=False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``starts``/``ends`` (removal spans in words), ``items`` for every row.

    With ``whole_row`` the input row comes along as struct ``row``.  Null or wordless texts have no spans; null or wordless items have
    no windows.  Items without an id count as one item whose id is the empty string; items of one id are one item.  An empty
    benchmark hits nothing.  Long items are cut into pieces, and a benchmark of more than ``block_bytes`` is searched block by block,
    each pass adding to what is found.  Repeated rows are searched one by one; an empty table gives no rows; other columns
    of either table are ignored.
    """
    spark = docs.sparkSession
    rows, place = text_rows(docs, doc_id, text, whole_row)
    found = T.StructType.fromDDL("n_words long, starts array<int>, ends array<int>, items array<string>")
    schema = T.StructType([*rows.schema, *found])
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    bench = saved(bench.mapInArrow(pieces, "i string, t string").distinct(), "benchmark")
    size = bench.agg(F.sum(F.octet_length("t") + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        own = bench.where(F.expr(f"pmod(xxhash64(i, t), {blocks})") == k)
        if k:
            rows = saved(rows, "block")  # one block of phrases in memory at a time
        phrases = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in own.collect()]))
        rows = rows.mapInArrow(frugal(_find(phrases, place)), schema)
    return rows.drop("text").withColumnRenamed("doc_id", doc_id)


def n_hit():
    """Words in the removal spans."""
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated():
    """The rule: at least a twentieth of the words is hit."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))
