"""Target-distribution importance resampling: the documents whose hashed n-grams look most like a target's, drawn by Gumbel keys.

Every document becomes an array of buckets, one for each of its words and pairs of words, written once. Counts of buckets over
all documents and over the target give each bucket a gain, an array of fixed length that scores the documents' arrays. The
score adds a Gumbel draw from a hash of the doc_id, so the highest scores are a sample without replacement by weight.

The k-th key of (score, doc_id) in their order is found by digits: a job counts the rows of a range of keys by the leading
digits in which they differ, at most 65,537 counts come back, and the range shrinks to the digit that holds the k-th. Only
rows up to that key are sorted, by ranges, and ranked by the number of rows in the ranges before.

Defined cases: null or empty texts have no words, no features and weight 0; a null doc_id hashes as an empty one and comes last
among equal scores; rows that repeat count and are drawn on their own, equal scores and ids by their number of features, and
otherwise equal rows are interchangeable; an empty target or table gives gains from what there is; texts of any length are
read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import dropped, lower_ascii, written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
DIGIT_BITS = 16
_LAST = (1 << 63) - 1


def bucket_arrays(rows: DataFrame, text: str, *keep: Column, buckets: int = BUCKETS) -> DataFrame:
    """``keep``, n_words, and the buckets of all words and of all pairs of consecutive words."""
    found = rows.select(*keep, F.coalesce(F.regexp_extract_all(lower_ascii(rows[text]), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>")).alias("w"))
    bucket = lambda feature: (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")
    less = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), less), F.slice("w", F.lit(2), less), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    names = [c for c in found.columns if c != "w"]
    return found.select(*names, F.size("w").cast("long").alias("n_words"), F.concat(F.transform("w", bucket), pairs).alias("buckets"))


def bucket_counts(arrays: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Occurrences by bucket, over all rows; as many numbers as buckets."""
    out = [0] * buckets
    for r in arrays.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each bucket
        out[r["b"]] = r["n"]
    return out


def bucket_gains(raw: Sequence[int], target: Sequence[int]) -> list[int]:
    """A thousand times the logarithm of how much likelier a bucket is in the target, with one added to each count."""
    n, total, goal = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (total + n) / ((s + 1.0) * (goal + n)))) for s, t in zip(raw, target, strict=True)]


def array_weight(gains: Sequence[int]) -> Column:
    """The floored mean of the gains of a row's buckets; 0 without any."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")  # folded into the plan as one constant
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    n = F.size("buckets").cast("long")
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0).cast("long"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel draw that a hash of the id gives."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, parts: Sequence[str], k: int, bits: int = DIGIT_BITS) -> list[int]:
    """The k-th smallest (from 1) of the composite keys of long columns, from counts of digits; shorter where what is left is
    drawn whole: all keys that begin with less than or the same as it are then the k smallest, or equal to the k-th."""
    key: list[int] = []
    for part in parts:
        low, high = rows.agg(F.min(part), F.max(part)).first()
        here = 0
        while low < high:
            shift = max((high - low).bit_length() - bits, 0)
            digit = F.shiftright(part, shift)
            counts = sorted((r["d"], r["n"]) for r in rows.filter(F.col(part).between(low, high)).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 ** bits + 1
            for d, here in counts:  # noqa: B007
                if k <= here:
                    break
                k -= here
            low, high = max(low, d << shift), min(high, (d << shift) + (1 << shift) - 1)
            if k == here:  # all of this digit
                low = high
        key.append(high)
        if k == here:
            break
        rows = rows.filter(F.col(part) == high)
    return key


def up_to(parts: Sequence[str], key: Sequence[int]) -> Column:
    """Whether a row's key is not behind ``key``, as far as that goes."""
    out = F.col(parts[len(key) - 1]) <= key[-1]
    for part, value in reversed(list(zip(parts, key[:-1], strict=False))):
        out = (F.col(part) < value) | ((F.col(part) == value) & out)
    return out


def ranked(rows: DataFrame, parts: Sequence[str], into: str = "rank") -> DataFrame:
    """``rows`` numbered from 1 in order of ``parts``: ranges are sorted, and their sizes say where each begins."""
    laid = rows.repartitionByRange(*parts).sortWithinPartitions(*parts).withColumn("__at", F.monotonically_increasing_id())
    laid = written(laid, "ranked")
    place = F.shiftright("__at", 33)
    sizes = laid.groupBy(place.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # a row for each range
    out = laid.withColumn("__range", place).join(F.broadcast(starts), "__range")
    return out.withColumn(into, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__range", "__at", "__before")


def importance_resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are not drawn."""
    arrays = written(bucket_arrays(docs, text, docs[doc_id].alias("__id"), buckets=buckets), "buckets")
    gains = bucket_gains(bucket_counts(arrays, buckets), bucket_counts(bucket_arrays(target, text, buckets=buckets), buckets))
    weighed = arrays.select("__id", "n_words", F.size("buckets").cast("long").alias("n_features"), array_weight(gains).alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("__id"), seed))
    scored = written(scored.withColumns({"__down": -F.col("score"), "__order": F.coalesce(F.col("__id").cast("long"), F.lit(_LAST))}), "scored")
    dropped(arrays)
    parts, fit = ["__down", "__order", "n_features"], scored.filter(F.col("n_words") >= least_words)
    out = lambda df, rank: df.select(F.col("__id").alias(doc_id), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    k = percent * fit.count() // 100
    if k == 0:
        return out(scored, F.lit(None))
    chosen = up_to(parts, kth_key(fit, parts, k)) & (F.col("n_words") >= least_words)
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    return out(ranked(scored.filter(chosen), parts), rank).unionByName(out(scored.filter(~chosen), F.lit(None)))
