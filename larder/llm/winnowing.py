"""Document fingerprints (operator 6) [native]: winnowing with SQL functions only.

A text's words (A-Z lower-cased) are hashed, the hash of every run of ``K``
words is one k-gram hash, and of every ``W`` successive k-gram hashes the
least is selected, the rightmost on ties, with its position.  Any run of
``K + W - 1`` words that two texts share makes at least one common selection.

The hash of ``2k`` words is made from the hashes of their two halves, and the
least of ``2w`` from the least of two halves, so a run costs the logarithm of
its length a place; ``K`` and ``W`` are powers of two.

A selection is one number: the upper 32 bits of the k-gram hash and, below
them, the position counted from the right, so the least number of a window is
the least hash at its rightmost place.  The number gives back hash and
position.  A text with fewer k-grams than a window is one window, with fewer
words than ``K`` its whole sequence is the one k-gram; without words it has no
selection.

The edited text of a document needs the next document (ascending id).  Ids
and lengths alone are range-partitioned to find neighbours; each document
then sends its beginning and its fingerprint to the one before it, so no
whole text crosses the network twice and no partition holds more than its
share of the ids.

Defined results: null text is empty.  Rows with equal ids are ordered by
a hash of their text; equal rows have one place in the order and equal
results; a null id comes first.  A single document is its own next.  Likeness is the
Jaccard coefficient of the distinct selected hashes; of two empty
fingerprints it is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 4
W = 8
_FAR = (1 << 31) - 1


def _pairs(array: str, apart: int, join) -> Column:
    """``join`` of every element and the one ``apart`` places on (null past the end)."""
    return F.zip_with(F.col(array), F.slice(F.col(array), apart + 1, F.greatest(
        F.size(array) - apart, F.lit(0))), join)


def with_selections(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``out``: the selections of ``text``, in order of position, as packed numbers."""
    step = f"_{out}_"
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # Every step is a column of its own: inside a lambda it would be evaluated for each element.
    df = df.withColumn(step, F.transform(words, lambda w: F.xxhash64(w)))
    width = 1
    while width < K:
        df = df.withColumn(step, _pairs(step, width, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    whole = F.slice(F.col(step), 1, F.greatest(F.size(step) - (K - 1), F.lit(1)))
    df = df.withColumn(step, F.transform(whole, lambda h, i: F.shiftleft(
        F.shiftright(h, 32), 32).bitwiseOR(F.lit(_FAR) - i)))
    df = df.withColumn(f"{step}n", F.size(step))
    width = 1
    while width < W:
        df = df.withColumn(step, _pairs(step, width, lambda a, b: F.least(a, b)))
        width *= 2
    return df.withColumn(out, F.array_distinct(F.slice(
        F.col(step), 1, F.greatest(F.col(f"{step}n") - (W - 1), F.lit(1))))).drop(step, f"{step}n")


def hashes(selections: str) -> Column:
    return F.array_distinct(F.transform(F.col(selections), lambda v: F.shiftright(v, 32)))


def positions(selections: str) -> Column:
    """Word positions (from 0) of the selections."""
    return F.transform(F.col(selections), lambda v: F.lit(_FAR) - v.bitwiseAND(F.lit(_FAR)))


def digest(selections: str) -> Column:
    """Hex digest of all selected hashes with their positions."""
    return F.sha2(F.array_join(F.transform(F.col(selections), lambda v: v.cast("string")), ","), 256)


def likeness(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(F.col(a), F.col(b)))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def neighbours(nodes: DataFrame) -> DataFrame:
    """Adds the place before (k0, k1, n_chars) to every distinct (k0, k1): the first has the last."""
    order = ["k0", "k1"]
    ranged = stored(nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
                    "winnowing-order")
    here = F.struct(*order, "n_chars")
    inside = ranged.withColumn("before", F.lag(here).over(
        Window.partitionBy("part").orderBy(*order)))
    # One row a partition: the last place of the partition before it, or of the last partition.
    ends = ranged.groupBy("part").agg(F.max(here).alias("last"))
    every = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(every).alias("left"),
                       F.max_by("last", "part").over(Window.partitionBy()).alias("wrap"))
    ends = ends.select("part", F.coalesce("left", "wrap").alias("left"))
    return (inside.join(ends, "part")
            .withColumn("before", F.coalesce("before", "left"))
            .select(*order, F.col("before.k0").alias("p0"), F.col("before.k1").alias("p1"),
                    F.col("before.n_chars").alias("p_chars"), "copies", "doc_id", "n_chars"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(
        "doc_id", "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k0"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("k1"))
    nodes = texts.groupBy("k0", "k1").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.length("text").cast("long")).alias("n_chars"),
        F.count(F.lit(1)).alias("copies"))
    # All uses below read the same three columns of the texts, so these are shuffled once.
    placed = texts.select("k0", "k1", "text").join(
        stored(neighbours(nodes), "winnowing-neighbours"), ["k0", "k1"])

    def sent(rows: DataFrame) -> DataFrame:
        rows = with_selections(rows, F.col("text"), "sel")
        return rows.select(
            F.col("p0").alias("k0"), F.col("p1").alias("k1"),
            F.expr("substring(text, 1, cast(p_chars div 4 as int))").alias("head"),
            hashes("sel").alias("next"))

    # Copies of a whole row send one beginning.
    heads = sent(placed.where("copies = 1")).unionByName(
        sent(placed.where("copies > 1").dropDuplicates(["k0", "k1"])))
    kept = F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))")
    both = placed.select("k0", "k1", "doc_id", "text", "n_chars").join(heads, ["k0", "k1"])
    both = both.select("doc_id", "n_chars", "text", "next", F.concat(kept, "head").alias("edited"))
    both = with_selections(both, F.col("text"), "sel")
    both = with_selections(both, F.col("edited"), "edited_sel")
    both = both.withColumn("own", hashes("sel")).withColumn("own_edited", hashes("edited_sel"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digest("sel").alias("fingerprint"), digest("edited_sel").alias("edited_fingerprint"),
        likeness("own", "own_edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        F.size("sel").cast("long").alias("n_selected"))
