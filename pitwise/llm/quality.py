"""Quality rules with thresholds that follow the corpus, in DataFrame operations alone.

Fixed base rules reject a document that is very short or mostly repeats. Beyond
them each metric, a share of two counts, has a threshold for every language and
source, read from mergeable quantile sketches of the documents that pass the
base rules: values fall into logarithmic buckets (relative error under
``2 * ERROR``) that are counted, and counts of sources add up to those of a
language and of all. On the scale of square roots, on which counts spread alike
at every height, the threshold is the metric's upper quantile plus ``RANGES``
times its distance from the median. No fixed value of a metric decides: a group
whose documents all have symbols keeps them. Small groups lean on their
language, and small languages on all, in proportion to ``PRIOR`` documents.

A document is rejected where a metric lies beyond the threshold by more than
counting noise: the count less ``NOISE`` times the root of the count and one.

Null and empty texts have no words and fail the base rules; null languages and
sources are groups of their own; a group with no document that passes has its
language's thresholds, or those of all; null and repeated doc_ids keep their
rows; an empty table gives none. Texts are read whole. Only ``doc_id``,
``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import stored

SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
ERROR, RANGES, NOISE, PRIOR = 0.01, 4.0, 3.0, 200
#: Each metric's counts, and the quantile that stands for its usual upper values.
METRICS = {"symbol_share": ("n_symbols", "word_chars", 0.75), "dup_line_share": ("n_dup_lines", "n_lines", 0.75), "repeat_share": ("n_repeat_words", "n_words", 0.9), "word_length": ("word_chars", "n_words", 0.75)}
_ZERO = -(1 << 30)
_BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeats(grams: Column) -> Column:
    """Words covered by those 3-word windows whose hash occurs more than once."""
    at = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.transform(F.array(at), lambda s: _covered(s))[0]


def _covered(s: Column) -> Column:
    twin = F.filter(s, lambda x, k: F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False)))
    places = F.sort_array(F.transform(twin, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def measured(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The base counts and metrics of each document; ``keep``: with the document itself as a struct ``doc``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("string")
    rows = docs.select(row.alias("doc"), F.col("doc_id").cast("bigint"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("parts", F.split("text", SPACE)).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select("doc", "doc_id", "lang", "source", F.array_remove("parts", "").alias("words"), (F.length("text") - F.size("parts") + 1).cast("bigint").alias("word_chars"), (F.size(F.split("text", SYMBOLS)) - 1).cast("bigint").alias("n_symbols"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    grams = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    rows = rows.withColumn("grams", grams).withColumn("n_words", F.size("words").cast("bigint"))
    again = F.when(F.size(F.array_distinct("grams")) == F.size("grams"), 0).otherwise(_repeats(F.col("grams")))
    rows = rows.withColumn("n_repeat_words", again.cast("bigint"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    every = F.struct(*_BASE[:-1], "n_lines", failed.alias("base_failed"), *[share(a, b).alias(m) for m, (a, b, _) in METRICS.items()])
    # through explode, so that no filter on a metric is pushed below and works it out once more
    return rows.select("doc", "lang", "source", F.explode(F.array(every)).alias("m")).select("doc", "lang", "source", "m.*")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: mergeable by adding ``n``. Documents that fail the base rules do not count."""
    step = math.log1p(2 * ERROR)
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(m) > 1e-6, F.ceil(F.ln(m) / step)).otherwise(_ZERO).cast("int").alias("bucket")) for m in METRICS])
    return rows.where("not base_failed").select("lang", "source", F.explode(metrics).alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's ``total`` and ``fence`` (on the scale of roots) of every metric."""
    group = Window.partitionBy(*keys, "metric")
    merged = counts.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    value = F.when(F.col("bucket") > _ZERO, F.exp(F.col("bucket") * math.log1p(2 * ERROR))).otherwise(0.0)
    level = F.create_map(*[F.lit(x) for m, (_, _, q) in METRICS.items() for x in (m, q)])[F.col("metric")]
    merged = merged.groupBy(*keys, "metric").agg(F.first("total").alias("total"), F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), value)).alias("middle"), F.min(F.when(F.col("upto") >= level * F.col("total"), value)).alias("upper"))
    return merged.select(*keys, "metric", "total", (F.sqrt("upper") + RANGES * (F.sqrt("upper") - F.sqrt("middle"))).alias("fence"))


def thresholds(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source and a threshold column for each metric, for every row of ``groups``: lang, source."""
    own, lang, every = fences(counts, ["lang", "source"]), fences(counts, ["lang"]), fences(counts, [])
    name = lambda q, p: q.select(*[F.col(c).alias(f"{p}_{c}") for c in q.columns])
    own, lang, every = name(own, "o"), name(lang, "l"), name(every, "e")
    rows = groups.select("lang", "source", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    rows = rows.join(own, rows.lang.eqNullSafe(F.col("o_lang")) & rows.source.eqNullSafe(F.col("o_source")) & (rows.metric == F.col("o_metric")), "left")
    rows = rows.join(lang, rows.lang.eqNullSafe(F.col("l_lang")) & (rows.metric == F.col("l_metric")), "left").join(every, rows.metric == F.col("e_metric"), "left")
    lean = lambda p, up: (F.coalesce(F.col(f"{p}_total") * F.col(f"{p}_fence"), F.lit(0.0)) + PRIOR * up) / (F.coalesce(f"{p}_total", F.lit(0)) + PRIOR)
    fence = lean("o", lean("l", F.col("e_fence")))
    cuts = rows.select("lang", "source", "metric", (fence * fence).alias("most"))
    return cuts.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"most_{m}") for m in METRICS])


def _verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rows.join(limits, rows.lang.eqNullSafe(limits.t_lang) & rows.source.eqNullSafe(limits.t_source))
    odd = F.lit(False)
    for m, (a, b, _) in METRICS.items():
        surely = F.greatest(F.col(a) - NOISE * F.sqrt(F.col(a) + 1), F.lit(0.0))
        odd = odd | F.coalesce(surely > F.col(f"most_{m}") * F.col(b), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~odd)


def _limits(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Thresholds as a stored table: its size is known, so that Spark joins it by broadcast only while it is small."""
    return stored(thresholds(groups.select("lang", "source").distinct(), stored(sketches(rows))))


def judged(docs: DataFrame) -> DataFrame:
    """The base counts and the verdict for every document."""
    rows = stored(measured(docs).drop("doc"))
    return _verdict(rows, _limits(rows, rows)).select(*_BASE, "kept", *METRICS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts are measured twice, which is less than to write and read them."""
    limits = _limits(measured(docs), docs)
    return _verdict(measured(docs, keep=True), limits).where("kept").select("doc.*")
