"""Merkle dataset manifest (operator 11).

Method: pointer-jumping proofs.

1. Every document's leaf is the hash of its fields.  Leaves are numbered
   within their source: rows are dealt to ranges of (source, id), the ranges
   counted, and a row's number is its range's offset plus its place inside
   the range, so no source is sorted in one task.
2. Sixteen consecutive nodes are a *run* and become their hash; a level at a
   time, until each source has one node (its subroot), then likewise over
   the subroots in source order.  A level is one grouping of at most sixteen
   rows a key.
3. All nodes of a run have the same ancestors, so the pointer table has one
   row a run: its members, the run that its hash is a member of (``up``) and
   a segment of sibling lists towards it.  Each round joins the table with
   itself on ``up``, which doubles the distance and puts the segments end to
   end, until every run reaches the root: log2(depth) rounds.
4. A leaf's proof is its run's other members and its run's segment.  The
   proof is folded from the (tampered) leaf and compared with the root.

Upper runs are the ``up`` of very many rows.  Rows are therefore joined in
two steps: the distinct (up, span of ``SPAN`` runs) pairs fetch the segment,
and the rows of a span fetch it from there, so a key has at most ``SPAN``
rows.

Defined results: null fields are hashed as ``-``, empty ones as ``0:``.
Null sources come first, null ids first in their source; rows with equal
ids are ordered by their leaf, and rows that are wholly equal are leaves of
their own, in any order (the tree is the same).  A table of one row is its
own root with an empty proof; an empty table gives no rows.  Only doc_id,
source, lang, n_chars and text are read; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rownum import bucketed_row_number
from .common import stored

FAN = 16
SPAN = 4_096
TAMPER = 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TOP = -1                               # the tree over the subroots; others are source numbers

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined(strings: Column) -> Column:
    return F.array_join(strings, "")


def leaf_of(text: Column) -> Column:
    return digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source key, leaf, and the leaf after tampering where the row is tampered with."""
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    source = F.col("source").cast("string")
    return docs.select(*FIELDS).select(
        "doc_id",
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("source_key"),
        leaf_of(text).alias("leaf"),
        F.when(hit, leaf_of(F.translate(text, _UPPER, _LOWER))).alias("tampered"),
        F.monotonically_increasing_id().alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tree`` (the source's number), ``place`` in it and its ``size``."""
    order = ["source_key", "doc_id", "leaf", "copy"]     # copy splits many equal rows
    ranged = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
                    "merkle-ranges")
    counts = stored(ranged.groupBy("source_key", "range").agg(F.count(F.lit(1)).alias("n")),
                    "merkle-counts")
    sources = counts.groupBy("source_key").agg(F.sum("n").alias("size"),
                                               F.min("range").alias("first"))
    # ranges ascend by source, so a source's number needs an order only within its first range
    sources = bucketed_row_number(sources.withColumn("all", F.lit(0)), ["all"], F.col("first"),
                                  [F.col("source_key")], "tree")
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .join(sources.select("source_key", "tree", "size"), "source_key"))
    inside = Window.partitionBy("source_key", "range").orderBy(
        *[F.col(c).asc_nulls_first() for c in order[1:]])
    return ranged.join(offsets, ["source_key", "range"]).select(
        "doc_id", "leaf", "tampered", (F.col("tree") - 1).alias("tree"), "size",
        (F.col("offset") + F.row_number().over(inside) - 1).alias("place"))


def run_key(tree: Column, level: Column, run: Column) -> Column:
    return F.concat_ws(":", tree.cast("string"), level.cast("string"), run.cast("string"))


def runs_of(nodes: DataFrame, level: int, n_trees: int) -> DataFrame:
    """One row a run of the nodes (tree, place, size, hash), with its hash and the run above."""
    run = F.floor(F.col("place") / FAN)
    runs = nodes.groupBy("tree", run.alias("run"), "size").agg(
        F.sort_array(F.collect_list(F.struct("place", "hash")))["hash"].alias("members"))
    above = F.ceil(F.col("size") / FAN)
    own_tree, source_tree = above > 1, F.col("tree") != TOP
    up = (F.when(own_tree, run_key(F.col("tree"), F.lit(level + 1), F.floor(F.col("run") / FAN)))
           .when(source_tree & F.lit(n_trees > 1),
                 run_key(F.lit(TOP), F.lit(0), F.floor(F.col("tree") / FAN))))
    step = F.struct("members", F.when(own_tree, F.col("run") % FAN).otherwise(
        F.when(source_tree, F.col("tree") % FAN)).cast("int").alias("next"),
        (~source_tree).alias("top"))
    return runs.select(
        "tree", "run", above.alias("size"), digest(joined(F.col("members"))).alias("hash"),
        run_key(F.col("tree"), F.lit(level), F.col("run")).alias("key"), up.alias("up"),
        F.floor(F.col("run") / SPAN).alias("span"), F.array(step).alias("segment"))


def grow(nodes: DataFrame, largest: int, n_trees: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, and each tree's last node as (tree, hash)."""
    levels, done = [], [nodes.where(F.col("size") == 1).select("tree", "hash")]
    nodes = nodes.where(F.col("size") > 1)
    while largest > 1:
        runs = stored(runs_of(nodes, len(levels), n_trees), "merkle-runs")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("place"), "size", "hash")
        done.append(nodes.where(F.col("size") == 1).select("tree", "hash"))
        nodes = nodes.where(F.col("size") > 1)
        largest = -(-largest // FAN)
    return levels, reduce(DataFrame.unionAll, done)


def jump(table: DataFrame, depth: int, store=stored) -> DataFrame:
    """Self-joins on ``up`` until every run's segment reaches the root."""
    reach = 1
    while reach < depth:
        ahead = table.select(F.col("key").alias("up"), F.col("up").alias("up2"),
                             F.col("segment").alias("more"))
        wanted = table.where(F.col("up").isNotNull()).select("up", "span").distinct()
        found = wanted.join(ahead, "up")
        table = store(table.join(found, ["up", "span"], "left").select(
            "key", F.col("up2").alias("up"), "span",
            F.when(F.col("more").isNull(), F.col("segment"))
             .otherwise(F.concat("segment", "more")).alias("segment")), "merkle-jump")
        reach *= 2
    return table


def folded(start: Column, place: Column, segment: Column) -> Column:
    """struct(hash, place, proof, subroot) after folding ``start`` along the segment."""
    empty = F.lit(None).cast("string")
    init = F.struct(start.alias("hash"), place.alias("place"), F.lit("").alias("proof"),
                    empty.alias("subroot"))

    def step(acc, x):
        left = joined(F.slice(x["members"], F.lit(1), acc["place"]))
        right = joined(F.slice(x["members"], acc["place"] + 2, F.lit(FAN)))
        own = F.element_at(x["members"], acc["place"] + 1)
        return F.struct(
            digest(F.concat(left, acc["hash"], right)).alias("hash"), x["next"].alias("place"),
            F.concat(acc["proof"], left, right).alias("proof"),
            F.coalesce(acc["subroot"], F.when(x["top"], own)).alias("subroot"))
    return F.aggregate(F.coalesce(segment, F.array().cast(
        "array<struct<members:array<string>,next:int,top:boolean>>")), init, step)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = stored(numbered(stored(leaves(docs), "merkle-leaves")), "merkle-numbered")
    n_trees, largest = rows.agg(F.max("tree") + 1, F.max("size")).first()
    if not n_trees:
        empty = F.lit(None).cast("string")
        return rows.select("doc_id", "leaf", *[empty.alias(c) for c in (
            "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    nodes = rows.select("tree", "place", "size", F.col("leaf").alias("hash"))
    low, subroots = grow(nodes, largest, n_trees)
    top, last = grow(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("place"),
                                     F.lit(n_trees).alias("size"), "hash"), n_trees, n_trees)
    root = last.first()["hash"]
    result = rows.withColumn("key", F.when(F.col("size") > 1, run_key(
        F.col("tree"), F.lit(0), F.floor(F.col("place") / FAN))).when(
        F.lit(n_trees > 1), run_key(F.lit(TOP), F.lit(0), F.floor(F.col("tree") / FAN))))
    levels = [x.select("key", "up", "span", "segment") for x in (*low, *top)]
    if levels:
        table = jump(reduce(DataFrame.unionAll, levels), len(levels))
        result = result.join(table.select("key", "segment"), "key", "left")
    else:
        result = result.withColumn("segment", F.lit(None).cast(
            "array<struct<members:array<string>,next:int,top:boolean>>"))
    place = F.when(F.col("size") > 1, F.col("place")).otherwise(F.col("tree"))
    place = (place % FAN).cast("int")
    changed = F.col("tampered").isNotNull() & (F.col("tampered") != F.col("leaf"))
    result = (result.withColumn("whole", folded(F.col("leaf"), place, F.col("segment")))
              .withColumn("folded_root", F.when(changed, folded(
                  F.col("tampered"), place, F.col("segment"))["hash"])
                  .otherwise(F.col("whole.hash"))))
    return result.select(
        "doc_id", "leaf", F.coalesce("whole.subroot", F.lit(root)).alias("subroot"),
        F.lit(root).alias("root"), digest(F.col("whole.proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"))


# --------------------------------------------------------------------------
# DuckDB twin
# --------------------------------------------------------------------------

_SQL_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_SQL_FIELD.format(text if c == "text" else c)
                                   for c in FIELDS) + ")"


_SQL_TEXT = f"translate(text, '{_UPPER}', '{_LOWER}')"

# crc32 bit by bit: 0xEDB88320 is the reflected polynomial.
_SQL_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN ({_SQL_CRC}) % {TAMPER} = 0 THEN {_sql_leaf(_SQL_TEXT)} END AS tampered
  FROM documents),
rows AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS size
  FROM leaves),
low AS (
  SELECT tree, 0 AS level, place, size, leaf AS hash FROM rows
  UNION ALL
  SELECT tree, level + 1, place // {FAN}, any_value((size + {FAN - 1}) // {FAN}),
         sha256(string_agg(hash, '' ORDER BY place))
  FROM low WHERE size > 1 GROUP BY tree, level, place // {FAN}),
top AS (
  SELECT 0 AS level, tree AS place, count(*) OVER () AS size, hash FROM low WHERE size = 1
  UNION ALL
  SELECT level + 1, place // {FAN}, any_value((size + {FAN - 1}) // {FAN}),
         sha256(string_agg(hash, '' ORDER BY place))
  FROM top WHERE size > 1 GROUP BY level, place // {FAN}),
root AS (SELECT hash AS root FROM top WHERE size = 1),
nodes AS (
  SELECT tree, level, place, size, hash FROM low
  UNION ALL SELECT {TOP}, level, place, size, hash FROM top),
siblings AS (
  SELECT a.tree, a.level, a.place, a.size, a.hash,
         coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level
       AND a.place // {FAN} = b.place // {FAN}
  GROUP BY ALL),
walk AS (
  SELECT tree AS doc_tree, place AS doc_place, tree, 0 AS level, place, size, '' AS proof,
         coalesce(tampered, leaf) AS hash
  FROM rows
  UNION ALL
  SELECT w.doc_tree, w.doc_place,
         CASE WHEN w.size = 1 THEN {TOP} ELSE w.tree END,
         CASE WHEN w.size = 1 THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.size = 1 THEN w.tree ELSE w.place // {FAN} END,
         CASE WHEN w.size = 1 THEN (SELECT count(DISTINCT tree) FROM rows)
              ELSE (w.size + {FAN - 1}) // {FAN} END,
         CASE WHEN w.size = 1 THEN w.proof ELSE w.proof || s.l || s.r END,
         CASE WHEN w.size = 1 THEN w.hash ELSE sha256(s.l || w.hash || s.r) END
  FROM walk w JOIN siblings s ON w.tree = s.tree AND w.level = s.level AND w.place = s.place
  WHERE NOT (w.tree = {TOP} AND w.size = 1))
SELECT d.doc_id, d.leaf, t.hash AS subroot, root.root, sha256(w.proof) AS proof_sha256,
       w.hash AS folded_root, w.hash = root.root AS verified
FROM rows d JOIN walk w ON w.doc_tree = d.tree AND w.doc_place = d.place
     AND w.tree = {TOP} AND w.size = 1
  JOIN top t ON t.level = 0 AND t.place = d.tree CROSS JOIN root
"""
