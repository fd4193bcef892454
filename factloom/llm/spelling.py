"""Spelling variants: words of a corpus, their exact neighbours at one edit, and the commoner form that each stands for.

Neighbours come from a dictionary of trie nodes.  The sorted words number the nodes of the trie of their beginnings, the sorted reversed
words those of their ends, so a word of n letters is two lists of n + 1 integers.  (node of the first i letters, node of the last n - i)
is the word itself, cut at i; (node of the first i, node of the last n - i - 1) is the word without letter i.  Words with equal pairs of
the second kind differ in that letter only; a pair of both kinds is a word and another with one letter more.  A pair has at most one word
of the first kind and one word for each letter of the alphabet of the second, so groups are bounded, and per word only the number of
neighbours and the commonest one leave a group: no pairs of words are made.

Null texts and texts without letters give no words; a null id is written as an empty text.  Repeated rows count as often as they are
there.  Texts are read whole, a stretch at a time.  Ties of counts go to the word that is first in the order of code points.  An empty
table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, numbered, saved, text_column, text_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: Code points of a text that are searched at once (then up to the end of a word), and distinct words that are counted before they are sent.
STRETCH, HELD = 1 << 20, 100_000
#: Words in a block of sorted words.
BLOCK = 1024


def runs(text: str):
    """Counters of the lower-cased words of stretches of a text."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        cut = OTHER.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        part = text[at:end] if at or cut else text
        part = part.lower() if part.isascii() else part.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        yield Counter(RUN.findall(part))
        at = end


def _count(least: int, period: int):
    def run(batches):
        held = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), text_column(batch, None).to_pylist(), strict=True):
                name = zlib.crc32(f"{'' if own is None else own}:".encode())
                for words in runs(text or ""):
                    for word, n in words.items():
                        if len(word) < least:
                            continue
                        h = zlib.crc32(word.encode(), name)
                        if h % period == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) >= HELD:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, doc_id="doc_id", text="text", least_letters=6, least_n=5, period=199) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences.

    Where the checksum of ``id:word`` is divisible by ``period``, that document's occurrences of the word have lost a letter.
    """
    rows = text_rows(docs, doc_id, text)[0]
    counts = rows.mapInArrow(frugal(_count(least_letters, period)), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# --- trie nodes -----------------------------------------------------------------------------------------------------------

def common(a: str, b: str) -> int:
    """Letters that two words begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # the first `low` are alike, the first `high` are not
        mid = (low + high) // 2
        if a[low : mid + 1] == b[low : mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


def walk(words: list[str], before: str | None, stack: list[int], new: int):
    """For each of some sorted words the nodes of its beginnings, given those that it shares with the word before and the next number.

    Yields (nodes from the first letter on, letters shared with the word before, next number).
    """
    for word in words:
        shared = common(before, word) if before is not None else 0
        stack = [*stack[:shared], *range(new, new + len(word) - shared)]
        new += len(word) - shared
        before = word
        yield stack, shared, new


def _summaries(batches):
    """Of each block: how many nodes are new, how few letters stay from what came before, and the last word's own nodes behind those."""
    for batch in batches:
        out = []
        for block, words, before in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "before")), strict=True):
            least = len(before or "")
            for stack, shared, new in walk(words, before, [-1] * least, 0):
                least = min(least, shared)
            out.append((block, common(before, words[0]) if before is not None else 0, least, new, stack[least:]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "shared", "least", "new", "tail"])


def _carry(batches):
    """Summaries in order to (block, first number, nodes that its first word shares with the word before)."""
    stack, at = [], 1
    for batch in batches:
        out = []
        for block, shared, least, new, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append((block, at, stack[:shared]))
            stack = [*stack[:least], *(at + k for k in tail)]
            at += new
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["block", "start", "stack"])


def _nodes(batches):
    for batch in batches:
        for keys, words, before, start, stack in zip(*(batch.column(c).to_pylist() for c in ("keys", "words", "before", "start", "stack")), strict=True):
            lists = [[0, *s] for s, _, _ in walk(words, before, stack, start)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["key", "nodes"])


def trie_nodes(words: DataFrame) -> DataFrame:
    """(key, nodes): for each of the sorted ``words`` (key, word, at) the numbers of its beginnings in one trie, from the empty one (0) on.

    Blocks of words are numbered side by side; what a block's words share with earlier blocks comes from one short row a block, read in order.
    """
    sorted_ = F.sort_array(F.collect_list(F.struct("at", "key", "word")))
    blocks = words.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(sorted_.alias("w"))
    blocks = saved(blocks.select("block", F.transform("w", lambda x: x["key"]).alias("keys"), F.transform("w", lambda x: x["word"]).alias("words")), "blocks")
    last = blocks.select((F.col("block") + 1).alias("block"), F.element_at("words", -1).alias("before"))
    blocks = saved(blocks.join(last, "block", "left"), "blocks")
    short = blocks.select("block", "words", "before").mapInArrow(_summaries, "block bigint, shared bigint, least bigint, new bigint, tail array<bigint>")
    carried = saved(short.repartition(1).sortWithinPartitions("block").mapInArrow(_carry, "block bigint, start bigint, stack array<bigint>"), "carry")
    return blocks.join(carried, "block").mapInArrow(_nodes, "key bigint, nodes array<bigint>")


# --- neighbours -----------------------------------------------------------------------------------------------------------

WHOLE, FIRST, AGAIN = 0, 1, 2  # the word itself; the word without a letter, and the same where the letter before is equal


def near(words: DataFrame) -> DataFrame:
    """(key, n_near, best) of words (key, word, n) that have neighbours; best is (-n, key) of the commonest; keys follow the words' order."""
    ahead = trie_nodes(words.select("key", "word", F.col("key").alias("at")))
    behind = trie_nodes(numbered(words.select("key", F.reverse("word").alias("word")).withColumn("all", F.lit("")), ["word"], ["all"]).select("key", "word", "at"))
    both = ahead.withColumnRenamed("nodes", "a").join(behind.withColumnRenamed("nodes", "b"), "key").join(words, "key")
    size, letters = F.size("a") - 1, F.split("word", "")
    both = both.withColumn("c", letters)
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("a", i).alias("a"), F.get("b", size - i).alias("b"), F.lit(WHOLE).alias("kind")))
    less = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("a", i).alias("a"), F.get("b", size - i - 1).alias("b"),
        F.when((i > 0) & (F.get("c", i) == F.get("c", i - 1)), AGAIN).otherwise(FIRST).alias("kind"),
    ))
    one = both.select("key", "n", F.explode(F.concat(whole, less)).alias("x")).select("x.a", "x.b", F.struct((-F.col("n")).alias("neg"), "key", "x.kind").alias("m"))
    groups = one.groupBy("a", "b").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1).select(
        "m", F.sort_array(F.filter("m", lambda x: x["kind"] > WHOLE)).alias("less"),
        F.sort_array(F.filter("m", lambda x: x["kind"] == FIRST)).alias("first"), F.get(F.filter("m", lambda x: x["kind"] == WHOLE), 0).alias("whole"),
    )
    each = groups.select("less", "first", "whole", F.explode("m").alias("own")).withColumn("longer", F.col("own.kind") == WHOLE)
    peers = F.when(F.get("less.key", F.lit(0)) == F.col("own.key"), F.get("less", F.lit(1))).otherwise(F.get("less", F.lit(0)))
    shorter = F.when(F.col("own.kind") == FIRST, F.col("whole"))
    bare = lambda x: F.when(x.isNotNull(), F.struct(x["neg"].alias("neg"), x["key"].alias("key")))
    each = each.select(
        F.col("own.key").alias("key"),
        F.when(F.col("longer"), F.size("first")).otherwise(F.size("less") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("k"),
        F.when(F.col("longer"), bare(F.get("first", F.lit(0)))).otherwise(F.least(bare(peers), bare(shorter))).alias("best"),
    )
    return each.where("k > 0").groupBy("key").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(key, root) for forms (key, form): the end of each chain, by jumping; a form is commoner than its word, so chains end."""
    at, done = saved(forms.select("key", F.col("form").alias("root")), "roots"), None
    while True:
        far = at.join(at.select(F.col("key").alias("root"), F.col("root").alias("far")), "root", "left")
        far = saved(far.select("key", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        at = far.select("key", "root")
        if not far.where("moved").take(1):
            return at


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n).

    ``form`` is the commonest neighbour if it is at least ``times`` as common as the word, ``root`` the end of the chain of forms.
    """
    words = words.select("word", F.col("n").alias("seen"), F.lit("").alias("all"))
    every = saved(numbered(words, ["word"], ["all"]).select(F.col("at").alias("key"), "word", F.col("seen").alias("n")), "words")
    found = every.join(near(every), "key", "left").withColumn("better", -F.col("best.neg") >= times * F.col("n"))
    found = saved(found.select(
        "key", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("better"), F.col("best.key")).alias("form"),
        F.when(F.col("better"), -F.col("best.neg")).alias("form_n"),
    ), "near")
    ends = roots(found.where("form is not null").select("key", "form"))
    word = lambda k: every.select(F.col("key").alias(k), F.col("word").alias(f"{k}_word"))
    out = found.join(ends, "key", "left").join(word("form"), "form", "left").join(word("root"), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
