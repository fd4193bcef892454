"""Quality rules whose cut-offs adapt to each language and source, with Spark expressions only.

Every document gets its counts inside its own row.  Each metric is then put into the bins of a
mergeable quantile sketch: integers with five leading bits kept, so a quantile is right within one
sixteenth, and two sketches merge by adding counts.  Sketches are kept for (language, source), merged
to languages and to the corpus.

Limits come from the sketches alone; there is no fixed distance.  The length of words has limits on both sides, three times
the span of the middle four fifths beyond it, from the smallest group with ``MIN_GROUP`` documents.  The other metrics are zero for most
documents and large for some: a sketch is cut in two where the parts differ most from each other (the largest variance between
them), and has a limit midway between the parts if the cut explains most of its variance.  A group's limit is the
geometric mean of its own, its language's and the corpus's, so that a single odd document can't set it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import saved

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 50
#: Metrics that have two sides, and those that are cut in two.
SPAN, CUT = ("word_length",), ("symbols", "dup_lines", "repeats")
#: Share of a sketch's variance that a cut has to explain.
CLEAR = 0.85


def features(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    ws = " \t\n\x0b\f\r"
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    split = base.select(
        "doc_id", "lang", "source",
        F.filter(F.split("text", SPACE + "+"), lambda x: x != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, ws, "") != "").alias("lines"),
        F.char_length(F.translate("text", ws, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 5,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 5),
                lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(5)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    keep = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    order = hashed.select(
        *keep,
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("p"),
    )
    p = F.col("p")
    twice = order.select(
        *keep,
        F.sort_array(
            F.transform(
                F.filter(
                    p,
                    lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
                    | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("at"),
    )
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct((x + 5).alias("end"), (a["n"] + 5 - F.greatest(F.lit(0), a["end"] - x)).alias("n")),
        lambda a: a["n"],
    )
    return twice.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _metrics() -> Column:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    values = {
        "word_length": F.expr("word_chars * 10") / words,
        "symbols": F.expr("n_symbols * 1000") / words,
        "dup_lines": F.expr("n_dup_lines * 1000") / lines,
        "repeats": F.expr("n_repeat_words * 1000") / words,
    }
    return F.array(*[F.struct(F.lit(k).alias("metric"), F.floor(values[k]).alias("v")) for k in (*SPAN, *CUT)])


def bin_floor(v: Column) -> Column:
    """Lower edge of the bin: the value with all but its five leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def thresholds(feats: DataFrame) -> DataFrame:
    """Per (lang, source) that occurs: ``limits`` map metric -> struct<low, high>."""
    rows = feats.where("n_words > 0").select("lang", "source", F.inline(_metrics()))
    sketch = rows.groupBy("lang", "source", "metric", bin_floor(F.col("v")).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    levels = sketch.select(
        "metric", "b", "n",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
                F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
                F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
            )
        ),
    ).groupBy("level", "lang", "source", "metric", "b").agg(F.sum("n").alias("n"))
    key = ["level", "lang", "source", "metric"]
    group = W.partitionBy(*key)
    upto = group.orderBy("b")
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    run = levels.select(
        *key, "b", F.lead("b").over(upto).alias("next"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all"),
        F.sum(n * b).over(upto).alias("s1"), F.sum(n * b).over(group).alias("s"), F.sum(n * b * b).over(group).alias("q"),
    )
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("b")))
    spans = run.where(F.col("metric").isin(*SPAN)).groupBy(*key).agg(F.max("all").alias("all"), at(10).alias("q10"), at(90).alias("q90"))
    # no span is told that is finer than a bin
    span = 3 * F.greatest(F.col("q90") - F.col("q10"), F.pow(F.lit(2), F.greatest(F.length(F.bin("q90")) - 5, F.lit(0))).cast("long"))
    spans = spans.select(*key, "all", (F.col("q10") - span).cast("double").alias("low"), (F.col("q90") + span).cast("double").alias("high"))
    # between: the variance between the parts below and above a bin's end, times the square of all
    n1, n_all = F.col("upto").cast("double"), F.col("all").cast("double")
    between = F.pow(n_all * F.col("s1") - n1 * F.col("s"), F.lit(2.0)) / (n1 * (n_all - n1))
    whole = n_all * F.col("q") - F.col("s") * F.col("s")
    cuts = run.where(F.col("metric").isin(*CUT) & F.col("next").isNotNull()).select(
        *key, "all", F.struct(between.alias("v"), (-F.col("b")).alias("b"), ((F.col("b") + F.col("next")) / 2).alias("mid"), (between >= CLEAR * whole).alias("clear")).alias("x"))
    cuts = cuts.groupBy(*key).agg(F.max("all").alias("all"), F.max("x").alias("x"))
    cuts = cuts.select(*key, "all", F.lit(None).cast("double").alias("low"), F.when(F.col("x.clear"), F.col("x.mid")).alias("high"))
    lim = spans.unionByName(cuts).where(F.col("all") >= F.when(F.col("level") < 2, MIN_GROUP).otherwise(0)).groupBy("level", "lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("limits")
    )
    own = levels.where("level = 0").select("lang", "source").distinct().alias("g").join(
        lim.where("level = 0").alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
    of = lambda side, m, x: F.col(f"{side}.limits")[m][x]

    def limit(m):
        if m in SPAN:
            both = [F.when(of(k, m, "high").isNotNull(), F.col(f"{k}.limits")[m]) for k in "olw"]
            return F.coalesce(*both)
        logs = F.array_compact(F.array(*[F.log(of(k, m, "high")) for k in "olw"]))
        mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(logs)
        return F.struct(F.lit(None).cast("double").alias("low"), F.when(F.size(logs) > 0, F.round(F.exp(mean), 3)).alias("high"))

    return (
        own.join(lim.where("level = 1").alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(F.broadcast(lim.where("level = 2").alias("w")))  # one row
        .select("g.lang", "g.source", F.map_from_arrays(F.array(*[F.lit(m) for m in (*SPAN, *CUT)]), F.array(*[limit(m) for m in (*SPAN, *CUT)])).alias("limits"))
    )


def quality_filter(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", source="source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` for every row.

    Null or blank text has no words and fails the base rule.  Null languages and sources form groups of their
    own.  Repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
    """
    feats = saved(features(docs, doc_id, text, lang, source), "quality")
    limits = thresholds(feats).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    joined = feats.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    bad = F.exists(
        _metrics(),
        lambda m: F.coalesce(m["v"] > F.col("limits")[m["metric"]]["high"], F.lit(False))
        | F.coalesce(m["v"] < F.col("limits")[m["metric"]]["low"], F.lit(False)),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return joined.select(
        F.col("doc_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(bad, F.lit(False))).alias("kept"),
    )
