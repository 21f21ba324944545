"""Near-duplicate documents: MinHash signatures, banding, verified links, connected components.

1. One map gives every text its set of word shingles, as a 16-byte fingerprint of
   the set and 128 minima of universal hashes ``a*x + b`` (16 bits of each). Texts with
   equal sets are one *node*, so copies never meet as pairs.
2. 32 bands of 4 minima put nodes into buckets. Inside a bucket all signatures are
   compared, in cells of bounded size; of the pairs with enough equal minima only a
   spanning forest leaves the task, never the pairs themselves.
3. Connected components of those edges (large-star and small-star, ``components.py``)
   are *neighbourhoods*: two texts that could be linked are in the same one. Each node's
   full set is made once and sent to its neighbourhood.
4. Inside a neighbourhood, again in cells of bounded size, pairs that pass the signature
   test and are not yet in one component are verified by the exact intersection of their full
   sets. Again only a spanning forest of the links leaves the task: a link inside one component
   changes nothing. Its components are the answer, that of all pairs.

A link needs ``100 * intersection >= percent * union``. Two texts at 0.8 share no
band with probability (1 - 0.8^4)^32 < 1e-7. A cell holds two chunks of ``CELL`` members, so a
neighbourhood of m different texts costs m/CELL times its size in shuffled rows; no cap.

Null and empty texts, and texts of white space, have an empty set, are linked with nothing and kept. A text
of fewer words than a shingle is one shingle. Rows with equal ids and texts are all kept or all
dropped. A null id is never the least unless all ids of its component are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import materialise, query, splittable, table
from framepair.llm.components import components
from framepair.llm.rules import UPPER
from framepair.llm.textnum import NOT_SPACE, U64, Texts, first_of_windows, mix, pieces, window_hashes

MINIMA, ROWS = 128, 4
BANDS = MINIMA // ROWS
SHINGLE, PERCENT = 5, 80
# A link at 0.8 has 102 of 128 equal minima on average, and fewer than 80 with probability 1e-6.
LEAST_EQUAL = 80
CELL = 1024  # members in a chunk; a cell compares two chunks
CELL_ROWS = 20_000  # members of small buckets that one call takes together

_rng = np.random.default_rng(20240612)
FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=U64) * U64(2) + U64(1)
SHIFTS = _rng.integers(0, 1 << 63, MINIMA, dtype=U64)


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, sorted by (row, hash)."""
    small = np.where(UPPER[t.data], t.data + 32, t.data).astype(np.uint8)
    starts, ends, row = t.runs(NOT_SPACE[t.data])
    words = t.span_hashes(starts, ends, small)
    at = first_of_windows(row, k)
    hashes, rows = [window_hashes(words, at, k)], [row[at]]
    n_words = np.bincount(row, minlength=t.n)
    first = np.cumsum(n_words) - n_words
    for short in range(1, k):
        some = np.flatnonzero(n_words == short)
        hashes.append(window_hashes(words, first[some], short) ^ U64(short))
        rows.append(some)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def sketches(t: Texts, k: int) -> tuple[np.ndarray, list[bytes | None], list[bytes | None]]:
    """Set size, fingerprint and signature of every text; None for an empty set."""
    h, r = shingle_sets(t, k)
    n = np.bincount(r, minlength=t.n)
    some = np.flatnonzero(n)
    nodes: list[bytes | None] = [None] * t.n
    signatures: list[bytes | None] = [None] * t.n
    if len(some):
        at = np.cumsum(n[some]) - n[some]
        marks = np.stack([np.add.reduceat(mix(h ^ U64(1 << 60)), at), np.bitwise_xor.reduceat(mix(h), at)], 1)
        minima = np.empty((len(some), MINIMA), np.uint16)
        for j in range(MINIMA):
            minima[:, j] = np.minimum.reduceat(h * FACTORS[j] + SHIFTS[j], at) >> U64(32)
        for i, row in enumerate(some):
            nodes[row], signatures[row] = marks[i].tobytes(), minima[i].tobytes()
    return n, nodes, signatures


def sketch(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, text):
                n, nodes, signatures = sketches(t, k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(n.astype(np.int64)), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["key", "n", "node", "signature"],
                )

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n long, node binary, signature binary")


def band_rows(nodes: DataFrame) -> DataFrame:
    """``(bucket, node)``: a node's 32 buckets."""
    width = 2 * ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("signature"), i * width + 1, F.lit(width)))
    )
    return nodes.select(F.explode(keys).alias("bucket"), "node")


def full_sets(docs: DataFrame, rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``(node, hashes)`` with the full sets of the texts whose keys are in ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in pieces(batch, text):
                h, r = shingle_sets(t, k)
                n = np.bincount(r, minlength=t.n)
                some = np.flatnonzero(n)
                at = np.cumsum(n[some]) - n[some]
                sets = [h[a : a + m].tobytes() for a, m in zip(at, n[some], strict=True)]
                sums = np.add.reduceat(mix(h ^ U64(1 << 60)), at) if len(some) else np.zeros(0, U64)
                xors = np.bitwise_xor.reduceat(mix(h), at) if len(some) else np.zeros(0, U64)
                nodes = [m.tobytes() for m in np.stack([sums, xors], 1)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    wanted = rows.select(F.col("key").alias("_key")).distinct().hint("shuffle_hash")
    chosen = docs.select(key, text).join(wanted, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return chosen.select(text).mapInArrow(run, "node binary, hashes binary")


def forest(n: int, others: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join 0..n-1 as all the edges would.

    ``others(x, can)`` gives the indices y among ``can`` that have an edge with x;
    it is only asked for y > x that are not yet joined with x.
    """
    label, edges = np.arange(n), []
    for x in range(n - 1):
        can = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        if not len(can):
            continue
        at = others(x, can)
        if len(at):
            joined, first = np.unique(label[at], return_index=True)
            edges += [(x, int(y)) for y in at[first]]
            label[np.isin(label, joined)] = label[x]
    return edges


def in_cells(members: DataFrame, group: str, size: str) -> DataFrame:
    """Members with their cells ``i <= j``: chunk i meets chunk j of the same group."""
    chunks = F.ceil(F.col(size) / CELL).cast("int")
    dealt = members.withColumns({"_chunk": F.pmod(F.xxhash64("node"), chunks).cast("int"), "_chunks": chunks})
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cells = dealt.select("*", F.least("_chunk", "_other").alias("i"), F.greatest("_chunk", "_other").alias("j"))
    # A chunk alone is a cell only if it is the only one: else the cells of two hold its pairs too.
    return cells.where((F.col("_chunks") == 1) | (F.col("i") != F.col("j"))).drop("_chunk", "_other", "_chunks")


def compared(minima: np.ndarray, n: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    def others(x: int, can: np.ndarray) -> np.ndarray:
        can = can[100 * np.minimum(n[can], n[x]) >= PERCENT * np.maximum(n[can], n[x])]
        return can[(minima[can] == minima[x]).sum(1) >= LEAST_EQUAL]

    return others


def edges_table(node: pa.ChunkedArray, edges: list[tuple[int, int]]) -> pa.Table:
    u, v = ([e[k] for e in edges] for k in (0, 1))
    return pa.table({"u": node.take(pa.array(u, pa.int64())), "v": node.take(pa.array(v, pa.int64()))})


def neighbours(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spanning edges ``(u, v)`` of the pairs in a bucket that pass the signature test."""
    cells = in_cells(members, "bucket", "size").join(nodes.select("node", "n", "signature"), "node")
    groups = max(1, -(-members.count() // CELL_ROWS))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))

    def run(part: pa.Table) -> pa.Table:
        bucket, i, j = (part.column(c).to_numpy() for c in ("bucket", "i", "j"))
        order = np.lexsort((j, i, bucket))
        n = part.column("n").to_numpy()[order]
        minima = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, MINIMA)[order]
        key = np.stack([bucket[order], i[order], j[order]], 1)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        edges: list[tuple[int, int]] = []
        size = np.diff(cut)
        # Most buckets hold two nodes: all of them in one step.
        a = cut[:-1][size == 2]
        alike = (minima[a] == minima[a + 1]).sum(1) >= LEAST_EQUAL
        alike &= 100 * np.minimum(n[a], n[a + 1]) >= PERCENT * np.maximum(n[a], n[a + 1])
        edges += [(int(order[x]), int(order[x + 1])) for x in a[alike]]
        for lo, m in zip(cut[:-1][size > 2], size[size > 2], strict=True):
            some = slice(lo, lo + m)
            edges += [(int(order[lo + x]), int(order[lo + y])) for x, y in forest(int(m), compared(minima[some], n[some]))]
        return edges_table(part.column("node"), edges)

    return cells.groupBy("task").applyInArrow(run, "u binary, v binary")


def links(placed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning edges of the verified links inside the neighbourhoods ``placed (node, place)``."""
    sizes = splittable(placed.groupBy("place").agg(F.count(F.lit(1)).alias("size")), "place", F.col("size") > 0)
    cells = in_cells(placed.join(sizes, "place"), "place", "size")
    cells = cells.join(nodes.select("node", "n", "signature"), "node").join(sets, "node")

    def run(part: pa.Table) -> pa.Table:
        n = part.column("n").to_numpy()
        minima = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, MINIMA)
        # Shingles by their number in the cell, one set behind the other.
        _, ids = np.unique(np.frombuffer(b"".join(part.column("hashes").to_pylist()), U64), return_inverse=True)
        at = np.cumsum(n) - n
        mark = np.zeros(int(ids.max()) + 1, bool)
        near = compared(minima, n)

        def others(x: int, can: np.ndarray) -> np.ndarray:
            can = near(x, can)
            if not len(can):
                return can
            mine = ids[at[x] : at[x] + n[x]]
            mark[mine] = True
            both = np.array([np.count_nonzero(mark[ids[at[y] : at[y] + n[y]]]) for y in can])
            mark[mine] = False
            return can[100 * both >= percent * (n[x] + n[can] - both)]

        return edges_table(part.column("node"), forest(len(n), others))

    return cells.groupBy("place", "i", "j").applyInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id, kept``."""
    rows = materialise(sketch(docs, key, text, shingle), "sketches")
    some = rows.where(F.col("node").isNotNull())
    nodes = some.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "nodes")
    bands = band_rows(nodes)
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    members = materialise(bands.join(splittable(buckets.where(F.col("size") > 1), "bucket", F.col("size") > 1), "bucket"), "members")

    tied = components(neighbours(members, nodes))
    placed = tied.select(F.col("u").alias("node"), F.col("v").alias("place"))
    placed = placed.unionByName(tied.select(F.col("v").alias("node"), F.col("v").alias("place")).distinct())
    chosen = nodes.join(placed.select("node"), "node", "left_semi").select("key")
    sets = full_sets(docs, chosen, key, text, shingle).join(placed.select("node"), "node", "left_semi").dropDuplicates(["node"])
    found = components(links(placed, nodes, sets, percent))

    labels = found.select(F.col("u").alias("node"), F.col("v").alias("label"))
    known = some.select("key", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("key").alias("component_id"))
    known = known.join(splittable(least, "label", F.octet_length("label") > 0), "label").select("key", "n", "component_id")
    alone = rows.where(F.col("node").isNull()).select("key", "n", F.col("key").alias("component_id"))
    done = known.unionByName(alone)
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op7_near_duplicates")
def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
