"""Language identification by a byte network that labels every position; document scores pool the positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from . import gru
from .shared import frugal, saved, small_or_plain, text_column, text_rows
from .wordhash import text_chunks

#: Training sample: documents of each language at most, and characters of each, from a place that its hash picks.
DOCS_PER_LANGUAGE = 400
CHARS_PER_DOC = 1200
CHUNK = 1 << 19

_LETTER = regex.compile(r"\p{L}")


def training_sample(labelled: DataFrame, text="text", lang="lang", docs=DOCS_PER_LANGUAGE, chars=CHARS_PER_DOC) -> DataFrame:
    """Bounded sample (lang, text): distinct texts that hash lowest, thinned before they are ranked."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")
    )
    counts = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    thin = rows.join(small_or_plain(counts, 64), "lang").where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit(4 * docs) * (1 << 20))
    thin = thin.groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies of a text are one
    ranked = thin.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= docs)
    start = F.pmod("h", F.greatest(F.char_length("text") - chars + 1, F.lit(1))).cast("int") + 1
    return ranked.select("lang", "h", F.substring(F.col("text"), start, F.lit(chars)).alias("text"))


def fit(labelled: DataFrame, text="text", lang="lang") -> tuple[list[str], dict]:
    """Languages and network weights from labelled rows; no more than the sample reaches the driver."""
    rows = sorted((r.lang, r.h, r.text) for r in training_sample(labelled, text, lang).collect())
    langs = sorted({r[0] for r in rows})
    rows = [(name, t.encode()) for name, _, t in rows if _LETTER.search(t)]
    return langs, gru.train([t for _, t in rows], np.array([langs.index(name) for name, _ in rows], np.int64), max(1, len(langs)))


def _predict(langs, weights, place):
    def run(batches):
        for batch in batches:
            column = text_column(batch, place)
            rest = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != "text"}
            for a, b, data, offsets in text_chunks(column, CHUNK):
                total, n = gru.document_scores(weights, data, offsets)
                score = total / np.maximum(n, 1)[:, None]
                known = np.array([bool(langs) and t is not None and bool(_LETTER.search(t)) for t in column.slice(a, b - a).to_pylist()], bool) & (n > 0)
                best = score.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(a, b - a) for c in rest.values()],
                        pa.array([langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                        pa.array(np.where(known, np.clip(score.max(1), 0, 1), 0.0), pa.float64()),
                    ],
                    names=[*rest, "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: tuple[list[str], dict], doc_id="doc_id", text="text", whole_row=False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for every row, and with ``whole_row`` the input row as struct ``row``.

    Every byte of a text is labelled by the network in the stretch of its document that it lies in, and the probabilities of its
    letters are pooled.  Null text, text without a letter and an untrained model give ``und`` with score 0.  Repeated rows are
    labelled one by one; an empty table gives no rows; other columns are ignored.  The weights are a few kilobytes.
    """
    rows, place = text_rows(docs, doc_id, text, whole_row)
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(frugal(_predict(*model, place)), schema).withColumnRenamed("doc_id", doc_id)
