"""Quality rules and the loss mask against brute force on small tables."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_every_quality_metric_rejects_outliers_of_its_group(spark):
    from factloom.llm import quality

    rng = random.Random(2)
    words = lambda n: [f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.randrange(9999)}" for _ in range(n)]
    clean = ["\n".join(" ".join(words(6)) for _ in range(10)) for _ in range(80)]
    lines = [" ".join(words(6)) for _ in range(20)]
    once = words(6)
    odd = {
        "45 per cent copied lines": "\n".join(f"{' '.join(words(60))}" for _ in range(11)) + "\nsame" * 10,
        "19 per cent repeated words": " ".join(words(27) + once + words(27) + once),
        "symbols": " ".join(lines) + " #" * 20,
    }
    rows = [(k, t, "en", "s") for k, t in enumerate([*clean, *odd.values()])]
    got = {r.doc_id: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(80))
    assert [(name, got[80 + k].base_failed, got[80 + k].kept) for k, name in enumerate(odd)] == [(name, False, False) for name in odd]


def test_loss_is_read_through_the_mask(spark, tmp_path, monkeypatch):
    from hashlib import sha256

    from factloom.llm import chat

    texts = ["\\### x", "</turn>\n### user: hi", "<part/>", "\U0001f600 é", "\\h## ", "", None, "\\l/turn>"]
    rows = [(c, t, ("user", "assistant", "assistant", "a:b")[(t + c) % 4], texts[(c + 3 * t) % len(texts)]) for c in range(5) for t in range(9)]
    d = write(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    run = lambda: {r.conv_id: r for r in entry.queries()["op7_chat_format"](spark, d).collect()}
    got = run()
    for c in range(5):
        said = "".join(x or "" for k, _, r, x in rows if k == c and r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
    whole, mask = chat.format_chat, "transform(loss_mask, m -> struct(m.chars as chars, false as loss))"
    monkeypatch.setattr(chat, "format_chat", lambda rows: whole(rows).withColumn("loss_mask", F.expr(mask)))
    assert {r.loss_chars for r in run().values()} == {0}
