"""Groups of spelling variants by anagram hashing.

The key of a word is the sum of the fifth powers of its letters, so words of the same letters share it, and adding, removing
or exchanging a letter changes it by that letter's value, or by the difference of two. Every word offers its key, and its key
less each of its letters; two words that are one letter apart meet where what they offer is equal: a word's own key at the
other's without its additional letter, or both without the letter that is exchanged. (No two sums of two fifth powers of
letters are equal, so a pair meets at one key.) Of words that meet, the order of letters is verified.

Large classes of anagrams would offer many pairs whose order is wrong, so an offer also carries a half of the word: of the m
letters that both share, either the first half stands before the change or the second half behind it. A pair that agrees in
both halves counts where the first does. No class is capped, and no pairs within a class are listed.

Words are counted before they are shuffled; from then on the work follows the number of different words. Forms are followed
to the last by doubling the steps, in at most as many rounds as doublings of ten times, from tables in the shared folder. Tables
that grow with the words are joined by sorting, whatever their files suggest, so no broadcast grows with the input.

Defined cases: null or empty texts have no words; a null doc_id counts as an empty one in what is hashed; rows that repeat
count as often as they occur; of near words with the same count the smallest in code-point order is the form; words without
near words have no form and are their own root; a word of any length is kept whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.llm.common import dropped, lower_ascii, written

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
DAMAGED = 31
WORDS_A_TASK = 50_000


def words_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damaged: int | None = DAMAGED) -> DataFrame:
    """``word``, a row for each occurrence: runs of letters with A-Z lower-cased.

    With ``damaged``, a run whose hash with its document's id is divisible by it loses a letter, as misspelled words do.
    """
    runs = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUN), 0)).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LETTERS).select("id", lower_ascii("run").alias("run"))
    if damaged is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    rows = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words with enough letters and occurrences."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def letter_value(letter: Column) -> Column:
    one = F.ascii(letter).cast("long")
    return one * one * one * one * one


def _offers(words: DataFrame) -> DataFrame:
    """What each word offers: twice a key, plus 1 for the second half, that half of its letters, and the word, its count and the
    code of the letter that is left out (0 for none)."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    keyed = words.select("word", "n", letters.alias("letters"))
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda total, c: total + letter_value(c))
    each = keyed.select("word", "n", key.alias("key"), F.explode(F.array_union(F.array_distinct("letters"), F.array(F.lit("")))).alias("letter"))
    value = F.when(F.col("letter") == "", F.lit(0).cast("long")).otherwise(letter_value(F.col("letter")))
    each = each.select("word", "n", F.ascii("letter").alias("letter"), (F.col("key") - value).alias("key"), (F.length("word") - F.length("letter")).alias("m"))
    first = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct((F.col("key") * 2).alias("at"), F.substring("word", F.lit(1), first).alias("half")), F.struct((F.col("key") * 2 + 1).alias("at"), F.right("word", F.col("m") - first).alias("half")))
    return each.select(F.inline(halves), "word", "n", "letter")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and the near word of largest count (near, near_n), for words with near words."""
    offers = _offers(words)
    other = offers.withColumnsRenamed({"word": "near", "n": "near_n", "letter": "other"})
    m = F.length("word") - (F.col("letter") > 0).cast("int")
    first = lambda c: F.substring(c, F.lit(1), F.floor(m / 2).cast("int"))
    once = (F.col("at") % 2 == 0) | (first("word") != first("near"))
    # Spark sizes offers by the file of words, of which each makes some twenty, and so would broadcast hundreds of megabytes
    met = offers.join(other.hint("merge"), ["at", "half"]).filter((F.col("letter") != F.col("other")) & once & (F.levenshtein("word", "near", 1) == 1))
    best = F.min(F.struct((-F.col("near_n")).alias("d"), "near"))
    # with its own count each side needs the same columns, so that one exchange serves both
    return met.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.d")).alias("near_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root, of forms (word, form) without cycles."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(further.hint("merge"), "root", "left").observe(seen, F.count("further").alias("n"))
        after = written(step.select("word", F.coalesce("further", "root").alias("root")), "roots")
        dropped(now)
        now = after
        if seen.get["n"] == 0:
            return now


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damaged: int | None = DAMAGED, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    seen = Observation()
    words = written(vocabulary(words_of(docs, text, doc_id, damaged)).observe(seen, F.count(F.lit(1)).alias("n")), "words")
    # a word makes some twenty offers, so the words are dealt out before
    dealt = words.repartition(1 + seen.get["n"] // WORDS_A_TASK, "word")
    found = words.join(near_words(dealt), "word", "left")
    form = (F.col("near_n") >= F.col("n") * times) & F.col("near").isNotNull()
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "forms")
    roots = last_forms(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
