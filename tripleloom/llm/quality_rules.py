"""Quality rules with DataFrame functions only: base counts, and a hashed n-gram log-likelihood ratio.

The n-grams are words and pairs of neighbouring words, hashed into ``buckets``. Two smoothed multinomials over the buckets are learned, one from trusted target documents and one from all
raw documents; a document's verdict is its sum of log ratios divided by its number of n-grams, compared with one
threshold, for every document. The threshold is given, or follows from the trusted documents: what is below the ratio that
all but a thousandth of them reach, by more than the spread of their middle half, goes.

The raw counts cover all rows, the target counts and the threshold all documents labelled good. One pass writes each row's counts and
bucket numbers to the shared folder; learning and scoring read those. The trusted rows are found by doc_id (``rows_of``) and written too; the threshold's
quantiles are exact, found by histograms that close in on them, so no task and no driver holds all ratios.

Defined results: a null text has no words, so ``base_failed`` is true; a row without words has ratio 0; with
no trusted document all ratios come from the smoothing alone; repeated rows and equal ids are scored row by row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .jaccard import split_by_ids

#: White space that parts words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def repeated_words(positions: Column) -> Column:
    """How many words the 3-word windows at these sorted positions cover."""
    step = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("long")


def base_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, grams (bucket numbers)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x))  # each word is hashed once
    split = docs.select("doc_id", text.alias("text")).select("doc_id", "text", hashes.alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    size, w = F.size("words"), F.col("words")
    none = F.array().cast("array<bigint>")
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(none)
    pairs = F.when(size >= 2, F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(none)
    counted = split.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        F.transform(F.concat(w, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int")).alias("grams"),
    )
    g = F.col("windows")
    ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(g)) < F.size(g), ordered).alias("ordered"),
        "grams",
    )
    o = F.col("ordered")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = hashed.withColumn("twice", F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1)))).drop("ordered")
    placed = twice.withColumn("at", F.sort_array(F.transform("twice", lambda x: x["i"]))).drop("twice")
    return placed.withColumn("n_repeat_words", F.coalesce(repeated_words(F.col("at")), F.lit(0).cast("long"))).drop("at")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids of all documents labelled good."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids``. Long rows stay where they are: a filter of fixed size lets through the ids and a few others, a second one
    knows those others, and only rows that both let through are shuffled to be told apart."""
    _, may = split_by_ids(rows, ids)
    others = stored(may.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "others")
    sure, doubtful = split_by_ids(may, others)
    return sure.unionByName(doubtful.join(ids, "doc_id", "left_semi").select(rows.columns))


def log_ratios(counted: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """log(target share / raw share) of each bucket, both smoothed by one; ``trusted``: the rows of counted that are the target."""
    sums = [{r["b"]: r["c"] for r in rows.select(F.explode("grams").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("c")).collect()} for rows in (counted, trusted)]  # at most `buckets` rows each
    raw, target = (sum(x.values()) + buckets for x in sums)
    return [math.log((sums[1].get(b, 0) + 1) / target) - math.log((sums[0].get(b, 0) + 1) / raw) for b in range(buckets)]


def quantiles(values: DataFrame, shares: list[float], bins: int = 1024) -> list[float] | None:
    """Exact quantiles, with linear interpolation, of the column ``x`` (no nulls); None without rows. Each round counts the values between the
    bounds of every wanted rank in ``bins`` parts and goes on within the part that holds it."""
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not whole["n"]:
        return None
    spots = [share * (whole["n"] - 1) for share in shares]
    ranks = sorted({r for spot in spots for r in (math.floor(spot), math.ceil(spot))})
    bounds = {r: (whole["lo"], whole["hi"], r) for r in ranks}  # least and most value, and the rank among the values between
    while wide := sorted({(lo, hi) for lo, hi, _ in bounds.values() if lo < hi}):
        x = F.col("x")
        part = lambda lo, hi: F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins)).cast("int")
        inside = [F.when(x.between(lo, hi), F.struct(F.lit(k).alias("k"), part(lo, hi).alias("b"))) for k, (lo, hi) in enumerate(wide)]
        placed = values.select("x", F.explode(F.array_compact(F.array(*inside))).alias("p"))
        counts = placed.groupBy("p.k", "p.b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k", "b").collect()
        for r, (lo, hi, left) in list(bounds.items()):
            if lo < hi:
                for row in (c for c in counts if wide[c["k"]] == (lo, hi)):
                    if left < row["c"]:
                        bounds[r] = row["lo"], row["hi"], left
                        break
                    left -= row["c"]
    at = lambda r: bounds[r][0]
    return [at(math.floor(spot)) + (spot - math.floor(spot)) * (at(math.ceil(spot)) - at(math.floor(spot))) for spot in spots]


def lowest_kept(trusted: DataFrame, share: float) -> float:
    """Where the ``share`` of trusted documents with the lowest ratios ends, less the middle half's spread; -inf without any."""
    low, a, b = quantiles(stored(trusted.filter("not base_failed").select(F.col("ratio").alias("x")), "trusted-ratios"), [share, 0.25, 0.75]) or (-math.inf, 0.0, 0.0)
    return low - (b - a)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, threshold: float | None = None, share: float = 0.001) -> DataFrame:
    """The base counts, base_failed, ratio (per n-gram) and kept of every row. Without ``threshold`` it is that of ``lowest_kept``."""
    counted = stored(base_counts(docs, buckets), "rules")
    trusted = stored(rows_of(counted.select("doc_id", "n_words", "n_repeat_words", "grams"), trusted_ids(labels)), "trusted")
    table = F.split(F.lit(",".join(map(repr, log_ratios(counted, trusted, buckets)))), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    ratio = total / F.greatest(F.lit(1), F.size("grams"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = lambda rows: rows.withColumn("ratio", ratio).withColumn("base_failed", failed)
    least = lowest_kept(judged(trusted), share) if threshold is None else threshold
    return judged(counted).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least)).drop("grams")
