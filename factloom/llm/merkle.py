"""Manifest of a dataset as a tree of SHA-256 digests whose inner nodes keep the hash's state before each child.

Rows are leaves.  Per group, leaves in the order of their ids; every 8 consecutive nodes become one until a single node is left, and the
groups' nodes likewise become the root.  A child's digest in hex is one block of the hash, so a parent keeps, beside its children, the
state before each: folding a changed child resumes that state with the replacement and its right siblings, and never reads what is left
of it.  Levels are built upwards and paths handed downwards by joins on a node's number divided by 8, so no key has more than 8 rows and
a group that holds most leaves is dealt like any other.

Null fields have a digest of their own, ids that are null come first, rows with equal ids are ordered by their digests, and repeated rows
are leaves of their own.  Texts are hashed whole.  An empty table gives no rows.  Columns that the leaf doesn't name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sha
from .shared import numbered, saved

WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<slot:int,state:binary,kids:array<binary>>"
#: Lanes that are hashed at once.
LANES = 1 << 13


def leaf(*fields: Column) -> Column:
    """Digest of a row as 32 bytes: each field as its count of bytes, a colon and its text, or a dash if null."""
    one = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256))


# --- Arrow columns of digests ---------------------------------------------------------------------------------------------

def _digests(column: pa.Array) -> np.ndarray:
    """(n, 32) bytes of a binary column without nulls."""
    n = len(column)
    if not n:
        return np.zeros((0, 32), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, 32)


def _column(digests: np.ndarray) -> pa.Array:
    n = len(digests)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(32)), pa.py_buffer(np.ascontiguousarray(digests))])


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column without nulls."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int32)
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), column.flatten()


def parent(kids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of nodes, and the state before each child, given all children's digests and each node's first one (and the end)."""
    count = np.diff(first)
    state, states = sha.fresh(len(count)), np.empty((len(kids), 32), np.uint8)
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > k)
        at = first[:-1][on] + k
        states[at] = sha.to_bytes(state[:, on])
        state[:, on] = sha.compress(state[:, on], sha.hex_block(kids[at]))
    return sha.finish(state, count), states


def resume(value: np.ndarray, slot: np.ndarray, state: np.ndarray, kids: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of the parents once the child in ``slot`` has ``value``: from the state before it, with what is right of it only."""
    now = sha.compress(sha.from_bytes(state), sha.hex_block(value))
    count = end - first
    for k in range(1, int((count - slot).max(initial=1))):
        on = np.flatnonzero(slot + k < count)
        now[:, on] = sha.compress(now[:, on], sha.hex_block(kids[first[on] + slot[on] + k]))
    return sha.finish(now, count)


def _make_parents(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, LANES):
            batch = whole.slice(at, LANES)
            first, kids = _lists(batch.column("kids"))
            digest, states = parent(_digests(kids), first)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), _column(states))
            yield pa.record_batch([*batch.columns, _column(digest), lists], [*batch.schema.names, "digest", "states"])


def _fold(batches):
    """Adds ``folded`` and ``proof`` to rows with ``value`` and ``path``."""
    for whole in batches:
        for at in range(0, whole.num_rows, LANES):
            batch = whole.slice(at, LANES)
            first, steps = _lists(batch.column("path"))
            slot = pc.struct_field(steps, 0).to_numpy(zero_copy_only=False)
            state = _digests(pc.struct_field(steps, 1))
            begin, kids = _lists(pc.struct_field(steps, 2))
            kids = _digests(kids)
            value, depth = _digests(batch.column("value")).copy(), np.diff(first)
            for k in range(int(depth.max(initial=0))):
                on = np.flatnonzero(depth > k)
                i = first[:-1][on] + k
                value[on] = resume(value[on], slot[i], state[i], kids, begin[i], begin[i + 1])
            text, proofs = kids.tobytes().hex(), []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                h = hashlib.sha256()
                for s, x, y in zip(slot[a:b].tolist(), begin[a:b].tolist(), begin[a + 1 : b + 1].tolist(), strict=True):
                    h.update(text[64 * x : 64 * (x + s)].encode())
                    h.update(text[64 * (x + s + 1) : 64 * y].encode())
                proofs.append(h.digest())
            yield pa.record_batch([*batch.columns, _column(value), pa.array(proofs, pa.binary())], [*batch.schema.names, "folded", "proof"])


# --- trees ----------------------------------------------------------------------------------------------------------------

def build(leaves: DataFrame) -> list[DataFrame]:
    """Levels of inner nodes (tree, at, n, kids, digest, states), lowest first, over leaves (tree, at, n, digest).

    ``n`` is the number of nodes that the tree has on a level; a tree is done where that is one.
    """
    n, levels, nodes = leaves.agg(F.max("n").alias("n")).first()["n"] or 0, [], leaves
    while n > 1:
        up = F.shiftright("at", 3)
        kids = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda k: k["digest"])
        runs = nodes.where("n > 1").select("tree", up.alias("up"), "at", "n", "digest").groupBy("tree", "up").agg(
            F.first(F.shiftright(F.col("n") + 7, 3)).alias("n"), kids.alias("kids")
        ).withColumnRenamed("up", "at")
        nodes = saved(
            runs.mapInArrow(_make_parents, "tree string, at bigint, n bigint, kids array<binary>, digest binary, states array<binary>"), "merkle"
        )
        levels.append(nodes)
        n = -(-n // WIDTH)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the last node of each tree."""
    out = leaves.where("n = 1").select("tree", "digest")
    for level in levels:
        out = out.union(level.where("n = 1").select("tree", "digest"))
    return out


def hand_down(leaves: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``leaves`` with their tree's columns of ``above`` (tree, path, ...) and the path from the leaf up, ``above``'s path at its end."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    kept = None  # (tree, at, *more, path) of the nodes of the level above, whose paths are known
    for level in reversed(levels):
        here = level.where("n = 1").select("tree", "at").join(above, "tree")
        if kept is not None:
            below = level.where("n > 1").select("tree", "at", F.shiftright("at", 3).alias("up"))
            here = here.unionByName(below.join(kept.withColumnRenamed("at", "up"), ["tree", "up"]).select("tree", "at", *more, _longer(F.col("at"))))
        kept = saved(here.join(level.select("tree", "at", "kids", "states"), ["tree", "at"]), "merkle")
    own = [c for c in leaves.columns if c not in ("tree", "at", "n")]
    out = leaves.where("n = 1").join(above, "tree").select(*own, *more, "path")
    if kept is not None:
        below = leaves.where("n > 1").withColumn("up", F.shiftright("at", 3)).withColumnRenamed("at", "own_at")
        out = out.unionByName(below.join(kept.withColumnRenamed("at", "up"), ["tree", "up"]).select(*own, *more, _longer(F.col("own_at"))))
    return out


def _longer(at: Column) -> Column:
    """The path of the child ``at`` of a node with ``kids``, ``states`` and ``path``."""
    slot = at.bitwiseAND(WIDTH - 1).cast("int")
    step = F.struct(slot.alias("slot"), F.get("states", slot).alias("state"), F.col("kids").alias("kids"))
    return F.concat(F.array(step), F.col("path")).alias("path")


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, bytes | None]:
    """Each row's ``leaf`` with ``subroot`` and ``path`` (one step a level: slot, state before it, children), and the root.

    ``rows`` have the columns of ``keep``, ``group``, ``order`` and ``leaf`` (see ``leaf``).
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # null comes first and stays apart from an empty text
    flat = saved(rows.select(F.col(group), tree.alias("tree"), F.col(order).alias("_by"), F.col("leaf").alias("digest"), *[F.col(c) for c in keep if c not in (group, order)]), "leaves")
    leaves = numbered(flat, ["_by", "digest"], ["tree"]).withColumnRenamed("_by", order)
    levels = build(leaves)
    groups = numbered(tops(leaves, levels).withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), ["name"], ["tree"])
    upper = build(groups)
    root = tops(groups, upper).first()
    start = groups.sparkSession.createDataFrame([("",)], "tree string").select("tree", F.array().cast(f"array<{STEP}>").alias("path"))
    above = saved(hand_down(groups, upper, start).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), "groups")
    return hand_down(leaves, levels, above).withColumnRenamed("digest", "leaf"), root and bytes(root["digest"])


def folded(rows: DataFrame, value: str) -> DataFrame:
    """Rows of a manifest with ``folded`` (the root that the digest in column ``value`` leads to) and ``proof`` (digest of all siblings)."""
    rows = rows.withColumn("value", F.col(value))
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("folded binary, proof binary")])
    return rows.mapInArrow(_fold, schema).drop("value", "path")
