"""The registered queries of the text operators: thin calls that derive digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, langid, merkle, pii, quality, secretscan, spelling, substrings, warc, wordpiece
from .shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return warc.read_warc(spark, path).where("gap is null").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op5_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda xs: F.array_join(
        F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(
        spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    )
    out = chat.format_chat(rows)
    # The parser reads the formatted string alone; the text of the loss is read through the mask.
    back = chat.read_chat(out.select(
        "conv_id", "formatted", F.char_length("formatted").cast("long").alias("formatted_chars"), chat.loss_text().alias("said")
    ).select(F.struct("conv_id", "formatted_chars", "said").alias("key"), "formatted"), "key")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "key.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.char_length("key.said").cast("long").alias("loss_chars"), F.sha2("key.said", 256).alias("loss_sha256"), "key.formatted_chars",
    )


def op8_quality_rules(spark, sf_dir):
    return quality.quality_filter(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf(*[text if c == "text" else F.col(c) for c in merkle.FIELDS])
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = docs.withColumn("leaf", fields(F.col("text"))).withColumn("now", F.when(tampered, fields(lower)).otherwise(F.col("leaf")))
    kept, root = merkle.manifest(rows, keep=("now",))
    root, low = F.lit(root.hex() if root else None), lambda c: F.lower(F.hex(c)).alias(c)
    return merkle.folded(kept, "now").select(
        "doc_id", low("leaf"), low("subroot"), root.alias("root"), low("proof").alias("proof_sha256"),
        low("folded").alias("folded_root"), (low("folded") == root).alias("verified"),
    )


def op13_secret_scan(spark, sf_dir):
    found = secretscan.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda xs: F.array_join(
        F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in secretscan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_token_counts, op4_decontaminate, op5_pii, op6_bpe, op7_chat_format, op8_quality_rules, op9_ngram_jaccard, op10_language_id, op11_spelling_variants, op12_merkle_manifest, op13_secret_scan)}
