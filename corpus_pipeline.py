"""From raw documents to token ids in five stages.

Every stage takes a table with ``doc_id``, ``text``, ``lang``, ``source`` and any further columns, and all but the last return the same
columns, whatever their names.  An empty table goes through as one.  Nulls stay nulls but for the text in the last stage; what each
stage does with null texts and ids, repeated rows and ties is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, jaccard, langid, pii
from factloom.llm.shared import new_path, saved, without

#: Documents whose best language has less of the positions' probability than this are rejected, as are those without any.
MIN_SCORE = 0.3


def language_id(spark, docs, sf_dir):
    """Documents without a language go; the network learns from the languages given with the documents.

    Null texts and texts without a letter have none.  Rows without a given language are judged like all others.  Repeated rows are judged
    one by one.  Of equal scores the first language by name counts.  Without any given language every document goes.
    """
    found = langid.predict(docs, langid.fit(docs), whole_row=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Of each component of similar documents the one with the smallest id stays.

    Null and blank texts are like nothing and stay, as do rows without an id that are like nothing.  A row that is there twice stays once;
    rows of one id with different texts stay, one of each text.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # ids of which no row stays, and those of which several do: far fewer than all, so that texts need not be dealt by id to find the rest
    ids = saved(jaccard.near_duplicates(docs).groupBy("doc_id").agg(F.count_if(kept).alias("n")).where("n <> 1"), "ids")
    rest = without(docs, "doc_id", ids.where("n = 0").select("doc_id"))
    # an id may be there twice only if rows were repeated
    return rest.dropDuplicates(["doc_id", "text"]) if ids.where("n > 1").take(1) else rest


def decontamination(spark, docs, sf_dir):
    """Documents of which a twentieth or more is benchmark text go.

    Null and wordless texts stay.  Null and wordless items hit nothing, items without an id count.  Repeated rows are judged one by one.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, bench, whole_row=True).where(~decontaminate.contaminated()).select("row.*")


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by its kind, and ``n_chars`` follows the new text.

    Null texts stay null, with null characters.  Where spans overlap the first stands for all.  Repeated rows are mended one by one.
    """
    found = pii.find_pii(docs, pii.fit(docs), whole_row=True)
    text = pii.masked(F.col("row.text"), F.col("spans"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns])


def byte_bpe(spark, docs, sf_dir):
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``text``, decoded from them, of every row.

    A null text has no ids and comes back empty.  Repeated rows and ids each keep a row; other columns end here.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("byte_bpe", byte_bpe),
]

#: Language identification is a trained network, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
