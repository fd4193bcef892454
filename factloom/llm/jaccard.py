"""Exact Jaccard links between documents on word shingles, through a token-group matrix.

1. Documents with equal shingle sets are one class.
2. Similar classes are put into groups: classes that share a min-hash key are compared with the most central
   classes of that key, and linked ones form groups (connected components, cut into blocks).  Texts are fetched only
   for pairs whose sizes allow a link and which agree in several keys; links between others are left to steps 3 and 4.
3. The token-group matrix holds, for each token in the rare part of a member's set, the blocks whose members
   have it.  A class meets only blocks of larger components with which it shares such a token, and only if the tokens
   that may still follow can reach the needed overlap.
4. A block that qualifies is opened: the union of its members' tokens bounds the overlap once more, then
   members are compared until one links.
Rare parts follow one order of all tokens, by a fixed-size frequency sketch, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import packs
from .components import components
from .shared import frugal, new_path, release, saved, sieve, small_or_plain, text_bytes, text_rows
from .wordhash import WHITE, Words, mix, starts_inside, text_chunks, windows

SHINGLE = 5
KEYS = 8
#: Classes of a min-hash key that the others are compared with, in each of the rounds.
PIVOTS = (1, 4)
#: Members of a block of the matrix, and queries that meet it in one task.
BLOCK = 256
QUERIES = 256
#: Keys of :data:`KEYS` that a class and a pivot have to share before their texts are compared.
AGREE = 3
#: Classes of a min-hash key that meet its pivots in one task.
KEY_ROWS = 1024
#: Cells of the frequency sketch: four bytes each while counting, one when it is sent out.
CELLS = 1 << 22
#: Bytes of text in a pack: the sets of a pack are in memory together.
PACK_BYTES = 2 << 20
CHUNK = 1 << 16
_MULT = (np.arange(KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(column: pa.Array):
    """Yield each row's sorted distinct shingle hashes."""
    for a, b, data, offsets in text_chunks(column):
        w = Words(data, offsets, WHITE, lower=True)
        h, first = w.hashes(), w.first
        at = starts_inside(first, SHINGLE)
        s = windows(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
        cut = np.searchsorted(at, first)
        for r in range(b - a):
            n = int(first[r + 1] - first[r])
            if n >= SHINGLE:
                yield np.unique(s[cut[r] : cut[r + 1]])
            elif n:
                yield windows(h[first[r] : first[r + 1]], n)  # the whole sequence is the one shingle
            else:
                yield np.zeros(0, np.uint64)


def _needed(n1, n2):
    """9 * overlap has to reach this: overlap / (n1 + n2 - overlap) >= 4 / 5."""
    return 4 * (n1 + n2)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    return 9 * np.intersect1d(x, y, assume_unique=True).size >= _needed(len(x), len(y))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(batches):
    for batch in batches:
        digest, size, keys, mark = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            digest.append(_digest(s) if len(s) else None)
            size.append(len(s))
            keys.append([int(mix(s * m).min() >> np.uint64(1)) for m in _MULT] if len(s) else [])
            mark.append(int.from_bytes(bytes(k & 255 for k in keys[-1]), "little", signed=True))  # the low byte of each key
        yield pa.record_batch(
            [batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(mark, pa.int64())],
            ["doc_id", "class", "n", "keys", "mark"],
        )


def _count_cells(batches):
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for s in shingle_sets(batch.column(1)):
            np.add.at(cells, (s >> np.uint64(40)).astype(np.int64) % CELLS, 1)
    part = np.flatnonzero(cells.reshape(-1, CHUNK).any(1))
    for k in part.tolist():
        own = pa.record_batch([pa.array(cells[k * CHUNK : (k + 1) * CHUNK])], ["c"])
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([packs.dump(own)], pa.binary())], ["chunk", "cells"])


def _sum_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in table.column("cells"):
        total += packs.load(x.as_py()).column(0).to_numpy()
    # eighths of a power of two are order enough
    level = np.floor(8 * np.log2(total + 1)).clip(0, 255).astype(np.uint8)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "cells": pa.array([level.tobytes()], pa.binary())})


def frequency_levels(counted: DataFrame) -> np.ndarray:
    """One byte for each cell of the sketch, counted over all representatives; a fixed 4 MB on the driver."""
    levels = np.zeros(CELLS, np.uint8)
    rows = counted.groupBy("chunk").applyInArrow(_sum_cells, "chunk int, cells binary")
    for r in rows.toLocalIterator():
        levels[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.uint8)
    return levels


def _rare(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rare part of a set in the common order: what a larger partner's link can't do without."""
    order = np.lexsort((s, levels[(s >> np.uint64(40)).astype(np.int64) % CELLS]))
    return s[order[: len(s) - (4 * len(s) + 4) // 5 + 1]]


def _pack_tokens(column, levels):
    """Rare tokens of all sets of a pack, their rows, places and set sizes."""
    parts, row, place, size = [], [], [], []
    for k, s in enumerate(shingle_sets(column)):
        if len(s):
            r = _rare(s, levels)
            parts.append(r)
            row.append(np.full(len(r), k))
            place.append(np.arange(len(r)))
            size.append(np.full(len(r), len(s)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(parts, np.uint64), cat(row, np.int64), cat(place, np.int64), cat(size, np.int64)


def _ask_tokens(levels, owners, size):
    def run(batches):
        for name, got in packs.groups(batches, size):
            t = _pack_tokens(got.column(1), levels.value)[0]
            keys, n = np.unique(t, return_counts=True)
            rows = [(o, name, keys[own].astype(np.uint32).tobytes(), (n[own] > 1).tobytes()) for o, own in packs.deal(keys, owners)]
            if rows:
                o, p, k, f = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(o, pa.int32()), pa.array(p, pa.binary()), pa.array(k, pa.binary()), pa.array(f, pa.binary())], ["owner", "pack", "keys", "twice"])

    return run


def _answer_tokens(table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    n = 1 + np.frombuffer(b"".join(table.column("twice").to_pylist()), np.uint8)
    keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    shared = (np.bincount(inverse, n, len(keys)) > 1)[inverse]
    cut = np.cumsum([0, *map(len, lists)]).tolist()
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"owner": table.column("owner"), "pack": table.column("pack"), "bits": pa.array(bits, pa.binary())})


TOKENS = "token long, class binary, n int, place int"


def _shared_tokens(levels, owners):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = dict(zip(right.column("owner").to_pylist(), right.column("bits").to_pylist(), strict=True))
        cols: list[list] = [[], [], [], []]
        for blob in left.column("blob"):
            got = packs.load(blob.as_py())
            t, row, place, size = _pack_tokens(got.column(1), levels.value)
            keys, inverse = np.unique(t, return_inverse=True)
            live = np.zeros(len(keys), bool)
            for o, own in packs.deal(keys, owners):
                live[own] = np.unpackbits(np.frombuffer(bits[o], np.uint8), count=len(own)).astype(bool)
            on = live[inverse]
            for c, v in zip(cols, (pa.array(t[on].view(np.int64)), got.column(0).take(pa.array(row[on])), pa.array(size[on], pa.int32()), pa.array(place[on], pa.int32())), strict=True):
                c.append(v)
        release()
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        return pa.table([pa.chunked_array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["token", "class", "n", "place"])

    return run


def _verify_pairs(batches):
    for batch in batches:
        x, y = shingle_sets(batch.column(2)), shingle_sets(batch.column(3))
        on = pa.array([similar(a, b) for a, b in zip(x, y, strict=True)], pa.bool_())
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(on)


def _open_blocks(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links of the queries with members of one block; one link of a query is enough, as members are one component."""
    a, b = [], []
    if members.num_rows and queries.num_rows:
        sets = list(shingle_sets(members.column("text").combine_chunks()))
        names = members.column("class").to_pylist()
        union = np.unique(np.concatenate(sets))
        least = min(map(len, sets))
        for q, s in zip(queries.column("class").to_pylist(), shingle_sets(queries.column("text").combine_chunks()), strict=True):
            inside = np.intersect1d(s, union, assume_unique=True)
            if 9 * len(inside) < _needed(len(s), max(least, (4 * len(s) + 4) // 5)):
                continue
            for name, m in zip(names, sets, strict=True):
                if similar(s, m):
                    a.append(q), b.append(name)
                    break
        release()
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


class _Join:
    """The stages over one corpus; every method returns a DataFrame."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.spark = docs.sparkSession
        self.docs, _ = text_rows(docs, doc_id, text)
        self.kind = docs.schema[doc_id].dataType.simpleString()
        self.bytes = text_bytes(docs, text)
        self.rows = saved(self.docs.mapInArrow(frugal(_describe), f"doc_id {self.kind}, class binary, n long, keys array<long>, mark long"), "sets")
        one = self.rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("mark").alias("mark"))
        self.classes = saved(one, "classes")
        self.unique = self.rows.groupBy("doc_id").count().where("count > 1").isEmpty()
        self.kept: DataFrame | None = None

    def texts(self, wanted: DataFrame | None = None, then=None, schema: str = "class binary, text string") -> DataFrame:
        """(class, text) of each wanted class (of all without ``wanted``), or what ``then`` makes of those batches in the same task.

        Where ids are not unique the digest is taken again, as one id may have several texts, and copies go.  Texts of all classes
        that came by a shuffle are saved once, however often they are asked for.
        """
        if wanted is None and self.kept is not None:
            return self.kept.mapInArrow(frugal(then), schema) if then else self.kept
        own = self.classes.select("class", F.col("doc_id").alias("_id"))
        if wanted is not None:
            own = saved(wanted.join(own, "class").select("class", "_id"), "wanted")
        side = small_or_plain(own, 64)
        # of many documents only those that may be wanted are dealt by id
        docs = sieve(own.select("_id"))(self.docs, "doc_id", "left_semi") if wanted is not None and side is own else self.docs
        rows = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "text")
        if not self.unique:

            def same(batches):
                for batch in batches:
                    on = [_digest(s) == c for s, c in zip(shingle_sets(batch.column(1)), batch.column(0).to_pylist(), strict=True)]
                    yield batch.filter(pa.array(on, pa.bool_()))

            rows = rows.mapInArrow(same, "class binary, text string").dropDuplicates(["class"])
        if then and (side is own or not self.unique):
            rows = saved(rows, "texts", "zstd")  # a shuffle may deal rows anew each time it runs; packs want one order
            self.kept = rows if wanted is None else self.kept
        return rows.mapInArrow(frugal(then), schema) if then else rows

    def two_texts(self, wanted: DataFrame) -> list[DataFrame]:
        """The texts saved once and read twice: two different tables to the analyzer."""
        path = new_path(self.spark, "texts")
        self.texts(wanted).write.parquet(path, compression="zstd")
        return [self.spark.read.schema("class binary, text string").parquet(path) for _ in range(2)]

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar."""
        pairs = saved(pairs.select("a", "b").distinct(), "pairs")
        x, y = self.two_texts(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
        x, y = x.toDF("a", "x"), y.toDF("b", "y")
        return saved(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(frugal(_verify_pairs), "a binary, b binary"), "linked")

    def keyed(self) -> DataFrame:
        """(key, class, salts, central, n, mark): min-hash keys that several classes share; central counts all of a class's partners.

        A key of many classes is dealt to ``salts`` tasks.
        """
        rows = self.classes.select("class", F.posexplode("keys").alias("k", "h")).select("class", F.struct("k", "h").alias("key"))
        # saved, so that the join reads two plain exchanges, which Spark may split where a key is hot
        shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
        hit = rows.join(shared, "key")
        central = hit.groupBy("class").agg(F.sum("c").alias("central")).join(self.classes.select("class", "n", "mark"), "class")
        salts = F.ceil(F.col("c") / KEY_ROWS).cast("int").alias("salts")
        return saved(hit.select("key", "class", salts).join(central, "class").select("key", "class", "salts", "central", "n", "mark"), "keyed")

    def with_comp(self, df: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return df.withColumn("comp", F.col("class"))
        return df.join(labels.toDF("class", "comp_"), "class", "left").withColumn("comp", F.coalesce("comp_", "class")).drop("comp_")

    def star(self, keyed: DataFrame, labels: DataFrame | None, pivots: int) -> DataFrame:
        """Candidate pairs of each class with the most central classes of its keys, across components only.

        Of these only pairs whose sizes allow a link and that agree in ``AGREE`` keys (of similar ones 999 of 1000 do; the matrix finds the
        links of the rest), as the text of a candidate costs far more than its key.
        """
        rows = self.with_comp(keyed, labels)
        pivot = F.struct("central", "class", "comp", "n", "mark")
        if pivots == 1:
            top = rows.groupBy("key").agg(F.max(pivot).alias("p"), F.max("salts").alias("salts"))
        else:
            best = W.partitionBy("key").orderBy(F.desc("central"), "class")
            top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pivots).select("key", pivot.alias("p"), "salts")
        top = top.select("key", "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).drop("salts")
        apart = F.col("mark").bitwiseXOR(F.col("p.mark"))
        agree = sum((F.shiftright(apart, 8 * k).bitwiseAND(255) == 0).cast("int") for k in range(KEYS))
        likely = (5 * F.least("n", "p.n") >= 4 * F.greatest("n", "p.n")) & (agree >= AGREE)
        return rows.join(top, ["key", "salt"]).where("comp <> p.comp").where(likely).select(
            F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")
        )

    def matrix_links(self, labels: DataFrame | None) -> DataFrame:
        """Links across components, found through the token-group matrix."""
        levels = self.spark.sparkContext.broadcast(frequency_levels(self.texts(None, _count_cells, "chunk int, cells binary")))
        owners = packs.owners(self.bytes)
        asked = self.texts(None, _ask_tokens(levels, owners, PACK_BYTES), "owner int, pack binary, keys binary, twice binary")
        known = asked.groupBy("owner").applyInArrow(_answer_tokens, "owner int, pack binary, bits binary")
        packed = self.texts(None, packs.packer(PACK_BYTES), "pack binary, blob binary")
        tokens = packed.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(_shared_tokens(levels, owners), TOKENS)
        sizes = self.with_comp(self.classes.select("class"), labels)
        blocks = F.ceil(F.col("members") / BLOCK)
        group = sizes.join(sizes.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp").select(
            "class", F.struct("members", "comp", F.pmod(F.xxhash64("class"), blocks).alias("part")).alias("block")
        )
        tokens = saved(tokens.join(group, "class"), "tokens")
        left = F.col("n") - F.col("place")
        matrix = tokens.groupBy("token", F.col("block").alias("m_block")).agg(
            F.max(left).alias("m_left"), F.min("n").alias("m_min"), F.max("n").alias("m_max")
        )
        least_n = F.greatest(F.col("m_min"), F.ceil(4 * F.col("n") / 5))
        # of two components the smaller one asks, so a large one is met as a few blocks and not member by member
        smaller = F.struct("block.members", "block.comp") < F.struct("m_block.members", "m_block.comp")
        found = saved(
            tokens.join(matrix, "token")
            .where(smaller & (4 * F.col("m_min") <= 5 * F.col("n")) & (5 * F.col("m_max") >= 4 * F.col("n")))
            .where(9 * F.least(left, F.col("m_left")) >= 4 * (F.col("n") + least_n))
            .select("class", F.col("m_block").alias("block")).distinct(),
            "found",
        )
        salts = found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
        asks = found.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).select("class", "block", "salt")
        opened = salts.join(group, "block").select("class", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        need = saved(asks.select("class").union(opened.select("class")).distinct(), "need")
        key = F.struct("block.comp", "block.part", "salt").alias("key")
        members, queries = (
            x.join(t, "class").select(key, "class", "text") for x, t in zip((opened, asks), self.two_texts(need), strict=True)
        )
        return saved(members.groupBy("key").cogroup(queries.groupBy("key")).applyInArrow(_open_blocks, "a binary, b binary"), "opened")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row.

    Documents link at a Jaccard similarity of 0.8 or more of their sets of distinct shingles of five lower-cased words (of all
    words, if there are fewer); the id is the smallest of the component.  Null or blank texts have no shingles and
    are their own component, as is every row whose id is null and that links with nothing.  Repeated rows are linked copies.
    An empty table gives no rows; other columns are ignored.
    """
    j = _Join(docs, doc_id, text)
    keyed = j.keyed()
    links, labels = None, None
    for pivots in PIVOTS:
        new = j.linked(j.star(keyed, labels, pivots))
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    links = links.unionByName(j.matrix_links(labels))
    labels = components(links)
    comp = j.with_comp(j.rows.select("doc_id", "class", "n"), labels).withColumn(
        "comp", F.coalesce("comp", F.col("class"))
    )
    least = saved(j.with_comp(j.classes.select("class", "doc_id"), labels).groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return comp.join(least, "comp", "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )
