"""Prefix trie of conversations by truncation peeling.

A node of depth d is a sequence of d turns ``(role, text)`` that at least one conversation
starts with; the root has no turns. The trie is peeled from its greatest depth:

1. A conversation becomes the *path* of its prefixes: after each turn a 128-bit key (SHA-256
   chained over the turns) and the code points so far. Texts go no further than this.
2. Conversations with one path are one *ending*, with their number and smallest id.
3. At depth d the endings of d turns are merged with the survivors of depth d + 1, whose last turn
   has been stripped, by one aggregate over the key of depth d. Whatever is below a node
   is complete by then, so children, leaves and savings are final in the same pass.
4. Between two depths at which a conversation ends, survivors that do not meet are stripped
   several turns at once: the turns in between are nodes with one child. A search over
   the depths in between finds the deepest one where two survivors meet.

There are as many rounds as depths at which conversations end or meet, however long
they are. Each round is a table in the shared folder. Aggregates are combined before they are
shuffled, so a turn or a whole conversation that very many share is no hot key. Two things
are held or read by one task: the keys of a single conversation (about 40 bytes a turn), and, row by row,
the ids that end at one node, because SHA-256 takes its input in order.

Turns with a null conversation id belong to no conversation and are left out. Null turn numbers come
first, null roles and texts are empty, equal turn numbers are ordered by role and
text, repeated rows are repeated turns. Without conversations there are no nodes. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framepair.llm.common import materialise, query, splittable, staging_path, table

KEY = 16
ROOT = bytes(KEY)
TURNS = "array<struct<pos:int,digest:binary,chars:int>>"
PATH = "array<struct<key:binary,upto:bigint>>"
PATH_TYPE = pa.list_(pa.struct([("key", pa.binary()), ("upto", pa.int64())]))
LEVEL = f"key binary, path {PATH}, n_convs long, conv_id long, n_children long, n_leaves long, saved long, depth int"
NODE = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: digests and lengths of each conversation's turns, in order."""
    known = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # The role's digest has a fixed width, so no two turns are written alike.
    digest = F.unhex(F.substring(F.sha2(F.concat(F.sha2("role", 256), "text"), 256), 1, 2 * KEY))
    marked = known.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), F.length("text").alias("chars"))
    return marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """``conv_id, depth, key, path`` of conversations given as ``conv_id, turns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("turns")
            flat = lists.flatten()
            digests, chars = flat.field("digest").to_pylist(), flat.field("chars").to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.asarray(lists.value_lengths(), np.int64)
            ends = np.cumsum(size)
            upto, keys, last = np.zeros(len(chars), np.int64), [], []
            for n, end in zip(size.tolist(), ends.tolist(), strict=True):
                key = ROOT
                for d in digests[end - n : end]:
                    key = hashlib.sha256(key + d).digest()[:KEY]
                    keys.append(key)
                upto[end - n : end] = np.cumsum(chars[end - n : end])
                last.append(key)
            steps = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(upto)], ["key", "upto"])
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), steps).cast(PATH_TYPE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(size.astype(np.int32)), pa.array(last, pa.binary()), paths], names=["conv_id", "depth", "key", "path"]
            )

    return convs.select("conv_id", "turns").mapInArrow(run, f"conv_id long, depth int, key binary, path {PATH}")


def end_digests(members: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the digest of the comma-joined ids that end at each node, read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key == now:
                    state.update(b",%d" % conv)
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    ordered = members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def key_at(depth: int) -> Column:
    return F.col("path")[depth - 1]["key"] if depth else F.lit(ROOT)


def upto_at(depth: int) -> Column:
    return F.col("path")[depth - 1]["upto"] if depth else F.lit(0).cast("long")


def stripped(level: DataFrame, depth: int, to: int) -> DataFrame:
    """What the nodes of ``depth`` bring to depth ``to``, with every turn below it stripped."""
    between = (F.col("n_convs") - 1) * (upto_at(depth - 1) - upto_at(to))
    return level.select(
        key_at(to).alias("key"), F.slice("path", 1, to).alias("path"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"),
        "n_leaves", (F.col("saved") + between).alias("saved"),
    )


def merged(level: DataFrame, depth: int) -> DataFrame:
    """One row per node of ``depth``; everything below it is complete."""
    total = lambda c: F.sum(c).alias(c)
    found = level.groupBy("key").agg(
        F.first("path").alias("path"), total("n_convs"), F.min("conv_id").alias("conv_id"), total("n_children"), total("n_leaves"), total("saved")
    )
    own = (F.col("n_convs") - 1) * (upto_at(depth) - upto_at(depth - 1) if depth else F.lit(0).cast("long"))
    return found.select(
        "key", "path", "n_convs", "conv_id", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved") + own).alias("saved"), F.lit(depth).alias("depth"),
    )


def in_between(level: DataFrame, depth: int, to: int) -> DataFrame:
    """The nodes with one child that lie between the nodes of ``depth`` and depth ``to``."""
    each = level.select("*", F.explode(F.sequence(F.lit(to + 1), F.lit(depth - 1))).alias("at"))
    before = F.when(F.col("at") > 1, F.element_at("path", F.greatest(F.col("at") - 1, F.lit(1)))["upto"]).otherwise(F.lit(0))
    parent = F.when(F.col("at") > 1, F.element_at("path", F.greatest(F.col("at") - 1, F.lit(1)))["key"]).otherwise(F.lit(ROOT))
    saved = F.col("saved") + (F.col("n_convs") - 1) * (upto_at(depth - 1) - before)
    return each.select(
        F.col("at").alias("depth"), F.element_at("path", F.col("at"))["key"].alias("key"), parent.alias("parent"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved"),
    )


def next_depth(level: DataFrame, depth: int, ending: int) -> int:
    """The deepest depth above ``depth`` at which a conversation ends or survivors meet; ``ending`` is the former."""
    if depth - ending == 1 or (count := level.count()) == 1:
        return ending
    # Survivors that meet at some depth are together at all depths above it.
    meet = lambda d: level.select(key_at(d).alias("k")).distinct().count() < count
    if not meet(ending + 1):
        return ending
    lo, hi = ending + 1, depth
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if meet(middle) else (lo, middle)
    return lo


def prefix_trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conv_id, turns`` (see :func:`sequences`).

    ``key, depth, parent, conv_id`` (smallest member), ``parent_conv_id, n_convs, n_children,
    n_leaves, saved`` (code points that sharing saves in the subtree) and ``ends_sha256``.
    The node's last turn is turn ``depth`` of conversation ``conv_id``.
    """
    spark = convs.sparkSession
    members = materialise(chained(convs), "paths")
    nodes, endings, levels = (staging_path(spark, tag) for tag in ("nodes", "endings", "levels"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved")]
    ended = members.groupBy("key", "depth").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    ended.select("key", "path", "n_convs", "conv_id", *zero, "depth").write.partitionBy("depth").parquet(endings)
    ended = spark.read.schema(LEVEL).parquet(endings)
    # As many numbers as there are lengths of conversations.
    depths = sorted((r[0] for r in ended.select("depth").distinct().collect()), reverse=True)
    written, above, depth = [], None, None
    if depths:
        depth = depths.pop(0)
    while depth is not None:
        found = ended.where(F.col("depth") == depth).drop("depth")
        level = found if above is None else above.unionByName(found)
        path = f"{levels}/{depth}"
        merged(level, depth).write.parquet(path)
        level = spark.read.schema(LEVEL).parquet(path)
        written.append((level, depth))
        if not depth:
            break
        depths = [d for d in depths if d < depth]
        to = next_depth(level, depth, depths[0] if depths else 0)
        if depth - to > 1:
            in_between(level, depth, to).write.mode("append").parquet(nodes)
        above, depth = stripped(level, depth, to), to
    # The levels' tables are read once more, without their paths.
    columns = [c.split()[0] for c in NODE.split(", ")]
    parents = lambda d: key_at(d - 1) if d else F.lit(None).cast("binary")
    for level, d in written:
        level.withColumn("parent", parents(d)).select(*columns).write.mode("append").parquet(nodes)
    if not written:
        return spark.createDataFrame([], f"{NODE}, parent_conv_id long, ends_sha256 string")
    all_nodes = spark.read.schema(NODE).parquet(nodes)
    up = all_nodes.select(F.col("key").alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    up = splittable(up, "_up", F.col("parent_conv_id").isNotNull())
    ends = end_digests(members)
    told = all_nodes.join(up, F.col("parent") == F.col("_up"), "left").drop("_up").join(ends, "key", "left")
    return told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


SHARED, BLOCK = 6, 100


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations of which the first turns come from the first conversation of their block of ids."""
    heads = convs.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, SHARED - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    found = convs.join(heads, F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast(TURNS)), F.lit(1), h)
    return found.select("conv_id", F.concat(head, F.filter("turns", lambda t: t["pos"] > h)).alias("turns"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos > h),
s AS (
  SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s),
n AS (
  SELECT d, turns[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends
  FROM m GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
o AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].t) ELSE 0 END AS own
  FROM n LEFT JOIN k USING (d, path)),
a AS (
  SELECT up AS d, path[1:up] AS path, sum(own) AS saved, sum((n_children = 0)::BIGINT) AS leaves
  FROM (SELECT path, own, n_children, unnest(range(0, d + 1)) AS up FROM o) GROUP BY 1, 2)
SELECT o.conv_id, o.d::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN a USING (d, path) LEFT JOIN n p ON p.d = o.d - 1 AND p.path = o.path[1:o.d - 1]
"""


@query("op13_prefix_trie", ORACLE)
def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = rebuilt(sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie(convs).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )
