"""SpotSigs fingerprints, in DataFrame functions only.

A signature is a common word (an anchor) with the chain of up to ``CHAIN`` content words that follow it before the next
anchor. A text's fingerprint is its set of signature hashes, so navigation and lists without running prose add little.
A text without signatures has one, the hash of its lower-cased words; a text without words that of the text itself.
Only the empty text has none. Likeness is the Jaccard similarity of the sets; two empty sets are alike.

``near_pairs`` joins sets with similarity at least ``threshold`` without loss. Sets are partitioned by length into classes
so wide that partners lie in the same or the next one; within a class, only sets that share one of their rarest signatures
(as many as the threshold leaves room for) meet, and pairs whose lengths alone rule the threshold out are pruned before
the sets are compared. Equal sets are one class from the start, so copies are not compared with one another.

Null text counts as empty. Rows with equal or null ids are separate rows. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import text_or_empty
from lodestone.session import cut_lineage

CHAIN = 3
# Anchors, common words of English, German, French and Spanish.
ANCHORS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "with", "be", "at", "by", "this", "an", "from",
           "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
           "le", "la", "les", "et", "un", "une", "du", "est", "que", "qui", "dans", "par", "pour", "pas", "sur", "avec", "au", "ou", "il", "elle",
           "el", "los", "las", "en", "y", "con", "una", "su", "no", "se", "lo", "del", "al", "es", "o", "más", "pero", "sus", "ya"]
_WORD = r"[\p{L}\p{N}]"
_ANCHOR = "(?:" + "|".join(ANCHORS) + ")"
SPOT = rf"(?<!{_WORD}){_ANCHOR}(?!{_WORD})(?:[^\p{{L}}\p{{N}}]+(?!{_ANCHOR}(?!{_WORD})){_WORD}++){{1,{CHAIN}}}"
APART = r"[^\p{L}\p{N}]+"


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text that is not null."""
    low = F.lower(text)
    found = F.transform(F.regexp_extract_all(low, F.lit(SPOT), F.lit(0)), lambda s: F.xxhash64(F.regexp_replace(s, APART, " ")))
    words = F.regexp_replace(low, APART, " ")
    alone = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.when(F.trim(words) == "", text).otherwise(words))))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(alone)))


def fingerprint(marks: Column) -> Column:
    """The set as text: 128 bits over the sorted signatures, behind their number."""
    joined = F.transform(marks, lambda m: F.hex(m))
    return F.concat(F.size(marks).cast("string"), F.lit("-"), F.md5(F.array_join(joined, " ")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def spot_signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, signatures) per row."""
    return docs.select(docs[f"`{id_column}`"].alias("doc_id"), signatures(text_or_empty(text_column)).alias("signatures"))


def classes(marked: DataFrame) -> DataFrame:
    """(doc_id, class_id) per row: rows of one class have equal sets; class_id is a hash of the set."""
    return marked.select("doc_id", F.xxhash64("signatures").alias("class_id"))


def near_pairs(marked: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) for classes of different, non-empty sets with similarity at least ``threshold``; a < b.

    A set of n signatures must share one of its n - ceil(threshold * n) + 1 rarest with any partner.
    """
    sets = cut_lineage(marked.where(F.size("signatures") > 0).groupBy(F.xxhash64("signatures").alias("class_id")).agg(F.first("signatures").alias("signatures")))
    each = sets.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    spread = each.groupBy("s").agg(F.count("*").alias("df"))
    ranked = each.join(spread, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("order"))
    room = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    length = F.floor(F.log(F.col("n").cast("double")) / -log(threshold) + 1e-9).cast("int")
    rare = cut_lineage(ranked.select("class_id", "n", length.alias("part"), F.explode(F.transform(F.slice("order", F.lit(1), room), lambda o: o["s"])).alias("s")))
    reach = rare.select(F.col("class_id").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(F.col("part") - 1, "part")).alias("part"), "s", F.col("part").alias("b_part"))
    met = rare.join(reach, ["part", "s"]).where("b_part > part or class_id < b").where(
        F.least("n", "b_n") >= F.greatest("n", "b_n") * threshold - 1e-9).select(F.col("class_id").alias("a"), "b").distinct()
    left, right = sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("x")), sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("y"))
    alike = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def chunks(docs: DataFrame, id_column: str, count: int) -> Column:
    """Number of the id range a row lies in; ranges hold about equal numbers of rows, later ids have higher numbers."""
    column = F.col(f"`{id_column}`")
    marks = [k / count for k in range(1, count)]
    limits = sorted(set(docs.select(column.cast("double").alias("i")).where("i is not null").approxQuantile("i", marks, 0.2 / count))) if marks else []
    if not limits:
        return F.lit(0)
    bounds = F.array(*[F.lit(v) for v in limits])
    return F.when(column.isNull(), -1).otherwise(F.size(F.filter(bounds, lambda v: v <= column.cast("double"))))


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count: int | None = None) -> DataFrame:
    """(doc_id, text, next_text) per row: the text of the next row in descending id order, the first after the last.

    Rows are dealt by ranges of ids and looked ahead in within a range, so no task orders the whole table; the last row
    of a range takes the first of the next lower range that has rows. Rows of equal id are ordered by a hash of the
    text; rows without an id come last.
    """
    spark = docs.sparkSession
    count = count or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), text_or_empty(text_column).alias("text"))
    rows = rows.withColumn("chunk", chunks(rows, "doc_id", count))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ahead = rows.repartition("chunk").withColumn("following", F.lead("text").over(Window.partitionBy("chunk").orderBy(*order)))
    # The first row of every range, at most one a range.
    keys = rows.select("chunk", "doc_id", F.xxhash64("text").alias("h"))
    first = keys.groupBy("chunk").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), (-F.col("doc_id")).alias("down"), "h")).alias("f"))
    there = cut_lineage(first.select("chunk", (-F.col("f.down")).alias("first_id"), F.col("f.h").alias("first_h")))
    below = there.select("chunk").withColumn("from_chunk", F.coalesce(F.lag("chunk").over(Window.orderBy("chunk")), F.max("chunk").over(Window.partitionBy())))
    heads = rows.join(F.broadcast(there), "chunk").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_h")))
    heads = heads.groupBy(F.col("chunk").alias("from_chunk")).agg(F.first("text").alias("head"))
    heads = below.join(heads, "from_chunk").select("chunk", "head")
    return ahead.join(heads, "chunk", "left").select("doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many, or all, first ones of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
