"""Greedy word-piece counts by one pass of a longest-match automaton.

The vocabulary is a trie with two roots, one for the beginning of a word and one for what follows.  Each node
has a failure link and the number of pieces that following the link completes, worked out beforehand, so
a word's pieces are counted in time linear in its length and never built.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Distinct words whose counts a task keeps; beyond, it starts afresh (results are the same).
MEMO = 500_000


class Automaton:
    """``first``: pieces that may begin a word; ``rest``: pieces that may follow (without any prefix)."""

    def __init__(self, first, rest):
        self.next: list[dict] = [{}, {}]  # 0 begins a word, 1 follows a piece
        piece = [False, False]
        for root, words in ((0, first), (1, rest)):
            for w in words:
                at = root
                for c in w:
                    nxt = self.next[at].get(c)
                    if nxt is None:
                        nxt = self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = nxt
                if w:
                    piece[at] = True
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        todo = deque((0, c, v) for c, v in self.next[0].items())
        todo.extend((1, c, v) for c, v in self.next[1].items())
        while todo:
            u, c, v = todo.popleft()
            todo.extend((v, d, x) for d, x in self.next[v].items())
            if piece[v]:
                self.link[v], self.popped[v] = 1, 1
                continue
            z, n_popped = self.link[u], self.popped[u]
            while z >= 0 and c not in self.next[z]:
                n_popped += self.popped[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.popped[v] = self.next[z][c], n_popped

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if greedy matching gets stuck (the word is then one unknown token)."""
        nxt, link, popped = self.next, self.link, self.popped
        u = n = 0
        for c in word:
            while (v := nxt[u].get(c)) is None:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return 0
            u = v
        while u != 1:
            n += popped[u]
            u = link[u]
            if u < 0:
                return 0
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word-first and following pieces of a sentencepiece vocabulary; its word mark tells them apart."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return [p[1:] for p in pieces if p[0] == "▁"], [p for p in pieces if "▁" not in p]


def _count(path):
    def run(batches):
        auto, memo = Automaton(*vocabulary(path)), {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = WORD.findall(text.as_py() or "")
                n = unknown = 0
                for w in words:
                    k = memo.get(w)
                    if k is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = auto.count(w)
                    n += k or 1
                    unknown += not k
                out.append((len(words), n, unknown))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocab_path: str, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` for every row; null or blank text has none of them.

    The vocabulary file must be readable on the executors.  Repeated rows are counted one by one; an empty table gives no
    rows; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_count(vocab_path), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("doc_id", doc_id)
