"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every source gets a target number of words; its ratio target / size is the number of copies that each of its documents
is expected to give. The expected copies are prefix-summed within the source, one random offset is added, and a document
is emitted once for each integer that its interval crosses. Documents are summed in order of size, so that the words taken
follow the target closely and not only the documents.

A source may hold a third of all rows, so the prefix sum has two levels: rows are numbered within (source, size class,
salt), and these groups are small however large the source is; the groups' offsets come from a table of their counts. Sizes
and hashes of the texts are worked out once and written, since counting and numbering both need them.

Defined cases: a null or empty text has size 0 and takes no words; null is a source of its own, after all others; rows that
repeat are sampled on their own, and rows with equal doc_id and text are interchangeable; texts of any length are counted
whole; an empty table gives an empty result; a corpus without words has targets of 0. Other columns of the input, whatever
their names, pass through :func:`repeat_documents` and are ignored by :func:`mixing_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SALTS = 64
SEED = "mix-1"
_GROUP = ["__src", "__nosrc", "__class", "__salt"]
_ORDER = ["__size", "__id", "__text"]


def _size_class(size: Column) -> Column:
    """Sizes that share their length in binary and their five leading bits; sorts as the sizes do."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 5), 5, "0"))


def _number(hexa: Column, digits: int) -> Column:
    return F.conv(F.substring(hexa, 1, digits), 16, 10)


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str, salts: int, *keep: Column) -> DataFrame:
    """What numbering a row needs, beside the columns to keep."""
    own = F.md5(F.encode(F.coalesce(docs[text].cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(*keep, word_count(docs[text]).alias("__size"), docs[doc_id].alias("__id"), own.alias("__text"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("__src"), docs[source].isNull().alias("__nosrc"))
    mixed = F.md5(F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(":"), F.col("__text")))
    return rows.withColumns({"__class": _size_class(F.col("__size")), "__salt": F.pmod(_number(mixed, 4).cast("long"), F.lit(salts))})


def source_targets(groups: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Targets by source from the groups' sizes: shares by weight, held at max_repeat times a source's size.

    With the sources in order of cap / weight, the level at which the first k are held is (total - their caps) / (weights
    of the rest). It rises as long as holding one more is right and falls afterwards, so the final level is its maximum.
    """
    order = Window.orderBy("__nosrc", "__src")
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), "__nosrc", "__src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = groups.groupBy("__src", "__nosrc").agg(F.sum("__words").alias("__source_size"))
    sources = sources.withColumn("__w", weight.cast("long")).withColumn("__cap", F.col("__source_size") * max_repeat)
    total, before = F.sum("__source_size").over(Window.partitionBy()), F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ((total - before).cast("double") / rest.cast("double")).alias("__level")
    sources = sources.select("*", level).withColumn("__level", F.max("__level").over(Window.partitionBy()))
    return sources.withColumn("__target", F.least(F.col("__cap").cast("double"), F.col("__w") * F.col("__level")))


def _with_copies(rows: DataFrame, counted: DataFrame, weights: tuple[int, ...], max_repeat: int, seed: str) -> DataFrame:
    """``rows`` with their copies; ``counted`` are the same rows, and need only have the keys."""
    groups = counted.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    targets = source_targets(groups, weights, max_repeat)
    ahead = Window.partitionBy("__src", "__nosrc").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).join(targets, ["__src", "__nosrc"]).drop("__n", "__words", "__w", "__cap", "__level")
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*_ORDER)) - 1 + F.col("__before")
    start = _number(F.md5(F.concat(F.lit(seed + ":"), F.col("__nosrc").cast("string"), F.lit(":"), F.col("__src"))), 6).cast("double") / F.lit(16777216.0)
    ratio = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    rows = rows.join(offsets, _GROUP).withColumns({"__place": place, "__start": start, "__ratio": ratio})
    crossed = F.floor(F.col("__start") + F.col("__ratio") * (F.col("__place") + 1)) - F.floor(F.col("__start") + F.col("__ratio") * F.col("__place"))
    return rows.withColumn("__copies", F.least(crossed, F.lit(max_repeat)).cast("long"))


def mixing_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, salts: int = SALTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target (its source's), copies and taken (size times copies), a row for each document."""
    rows = written(_keyed(docs, text, source, doc_id, salts), "sizes")
    out = _with_copies(rows, rows, weights, max_repeat, seed)
    return out.select(F.col("__id").alias(doc_id), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))


def repeat_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, salts: int = SALTS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it.

    Texts are shuffled once, with their rows in one column, so that no name of theirs meets a name used here.
    """
    counted = written(_keyed(docs, text, source, doc_id, salts).select(*_GROUP, "__size"), "sizes")
    rows = _keyed(docs, text, source, doc_id, salts, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    out = _with_copies(rows, counted, weights, max_repeat, seed).filter("__copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select("__row.*")


#: The same plan in SQL, for the default parameters.
MIXING_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, coalesce(source, '') AS src, source IS NULL AS nosrc,
    lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 1, 5), 5, '0') AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 4))::BIGINT % 64 AS salt FROM rows_
), sources AS (
  SELECT src, nosrc, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY nosrc, src) - 1) % 3) + 1]::BIGINT AS w
  FROM keyed GROUP BY src, nosrc
), levels AS (
  SELECT *, source_size * 3 AS cap, ((sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY (source_size * 3)::DOUBLE / w, nosrc, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY (source_size * 3)::DOUBLE / w, nosrc, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS lev FROM sources
), targets AS (
  SELECT src, nosrc, source_size, least(cap::DOUBLE, w * (SELECT max(lev) FROM levels)) AS target FROM levels
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY k.src, k.nosrc ORDER BY k.class, k.salt, k.size, k.doc_id NULLS FIRST, k.h) - 1 AS place,
    ('0x' || substr(md5('mix-1:' || (CASE WHEN k.nosrc THEN 'true' ELSE 'false' END) || ':' || k.src), 1, 6))::BIGINT / 16777216.0::DOUBLE AS start_,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS ratio
  FROM keyed k JOIN targets t ON k.src = t.src AND k.nosrc = t.nosrc
), counted AS (
  SELECT *, least(floor(start_ + ratio * (place + 1)) - floor(start_ + ratio * place), 3)::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM counted
"""
