"""Quality rules with thresholds that adapt to each language and source.

Each metric of a text is counted in an integer histogram whose buckets are exact below 64 and about 3 % wide above.
Histograms of parts add up to the histogram of the whole, so they are merged freely: over tasks, and from language and
source up to the language and to the whole corpus for groups too small to have thresholds of their own. Fences come
from quantiles of the histograms, and are joined back to the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
RUN = 5
#: Metric and the slack that its fence gets on top of the spread, so that near-constant groups keep clean texts.
METRICS = {"symbol_rate": 300, "dup_line_rate": 300, "capital_rate": 300, "word_length": 150}
#: Metrics with a lower fence as well.
TWO_SIDED = ("word_length",)
QUARTILES = (25, 50, 75)
#: Rows below which a group takes the thresholds of the next larger one.
LEAST_ROWS = 200
SPREADS = 3


def _repeats(words: Column) -> tuple[Column, Column]:
    """Hashes of all runs of five words, and whether one occurs twice."""
    runs = F.when(F.size(words) >= RUN, F.transform(
        F.sequence(F.lit(0), F.size(words) - RUN), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(RUN)))
    )).otherwise(F.expr("cast(array() as array<bigint>)"))
    return runs, F.size(F.array_distinct("_runs")) < F.size("_runs")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, base counts and metrics of whole texts; row-wise."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", "lang", "source", text.alias("_text"), F.filter(F.split(text, SPACES), lambda w: w != "").alias("_words"))
    runs, twice = _repeats(F.col("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    counted = words.select(
        "doc_id", "lang", "source", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("_capitals"), lines.alias("_lines"), runs.alias("_runs"),
    )
    # Only texts with a repeated run are sorted; equal runs are then neighbours.
    placed = F.when(twice, F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_runs = counted.withColumn("_placed", placed).drop("_runs")
    again = F.transform("_placed", lambda s, i: F.when(
        F.coalesce(F.get("_placed", i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_placed", i + 1)["h"] == s["h"], F.lit(False)), s["i"]
    ))
    starts = sorted_runs.withColumn("_starts", F.sort_array(F.array_compact(again))).drop("_placed")
    covered = F.aggregate(
        "_starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda state, i: F.struct((state["n"] + i + RUN - F.greatest(i, state["end"])).alias("n"), (i + RUN).alias("end")),
    )["n"]
    n_lines = F.size("_lines")
    measured = starts.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "_capitals", n_lines.alias("_n_lines"),
    )
    rates = {
        "symbol_rate": _rate("n_symbols", "n_words", 1000), "dup_line_rate": _rate("n_dup_lines", "_n_lines", 1000),
        "capital_rate": _rate("_capitals", "word_chars", 1000), "word_length": _rate("word_chars", "n_words", 100),
    }
    return measured.withColumns(rates).drop("_capitals", "_n_lines")


def _rate(part: str, whole: str, scale: int) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.lit(scale) * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def bucket_of(value: Column) -> Column:
    """Bucket of a whole number from 0: 32 buckets for each power of two above 64."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(32 * shift + F.floor(value / F.pow(F.lit(2), shift))).cast("long")


def top_of(bucket: Column) -> Column:
    """Largest number of a bucket."""
    shift = F.floor(bucket / 32) - 1
    return F.when(bucket < 64, bucket).otherwise((bucket - 32 * shift + 1) * F.pow(F.lit(2), shift) - 1).cast("long")


def histograms(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n; counts are combined before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket_of(F.col(m)).alias("bucket")) for m in METRICS))).alias("p")
    return rows.select("lang", "source", pairs).groupBy("lang", "source", F.col("p.metric").alias("metric"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and metric: rows, and the tops of the buckets that hold the quartiles. A key has a few hundred buckets."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "rows": F.sum("n").over(by)})
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, top_of(F.col("bucket")))).alias(f"q{q}") for q in QUARTILES]
    return ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), *at)


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and for each metric its fences, from the smallest of group, language and corpus that has enough rows."""
    own, lang, every = quartiles(sketches, ["lang", "source"]), quartiles(sketches, ["lang"]), quartiles(sketches, [])
    names = ["rows", *(f"q{q}" for q in QUARTILES)]
    for level, frame in (("l", lang), ("e", every)):
        other = frame.select(F.col("metric").alias("_m"), *([F.col("lang").alias("_l")] if level == "l" else []), *(F.col(x).alias(f"{level}_{x}") for x in names))
        same = (F.col("metric") == F.col("_m")) & (F.col("lang").eqNullSafe(F.col("_l")) if level == "l" else F.lit(True))
        own = own.join(other, same).drop("_m", "_l")
    pick = {x: F.when(F.col("rows") >= LEAST_ROWS, F.col(x)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{x}")).otherwise(F.col(f"e_{x}")) for x in names[1:]}
    chosen = own.select("lang", "source", "metric", *(c.alias(x) for x, c in pick.items()))
    slack = F.element_at(F.create_map(*(F.lit(x) for pair in METRICS.items() for x in pair)), F.col("metric"))
    spread = SPREADS * (F.col("q75") - F.col("q25")) + slack
    fenced = chosen.select("lang", "source", "metric", (F.col("q75") + spread).alias("high"), (F.col("q25") - spread).alias("low"))
    sides = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in METRICS for s in (("high", "low") if m in TWO_SIDED else ("high",))]
    return fenced.groupBy("lang", "source").agg(*sides)


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, metrics, fences, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    ``base_failed``: fewer than 10 words, or more than 20 % of the words inside repeated runs of five. ``kept``: not
    base_failed and every metric within the fences of its language and source. Null and empty texts have no words and
    fail. A null language or source is a group like any other. Repeated rows are judged one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(features(docs))  # narrow rows, read twice
    fences = thresholds(histograms(rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = reduce(lambda a, b: a & b, [F.col(m) <= F.col(f"{m}_high") for m in METRICS] + [F.col(m) >= F.col(f"{m}_low") for m in TWO_SIDED])
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)
