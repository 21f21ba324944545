"""Pairing by name: equi, stem, suffix and decoupled joins, with reject reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.functions.hashing import hash_choice
from framepair.functions.names import score_stem
from framepair.operators import ordered
from framepair.operators.lookup import lookup


def pair_by_name(rgb: DataFrame, ir: DataFrame, keys: Sequence[str] = ("rec_id", "name")) -> DataFrame:
    """Frames present on both sides under one name. Join metadata, attach pixels after."""
    return rgb.join(ir, list(keys), "inner")


def without_twin(rgb: DataFrame, ir: DataFrame, keys: Sequence[str], reason: str = "no IR twin") -> DataFrame:
    return rgb.join(ir.select(*keys), list(keys), "left_anti").withColumn("reason", F.lit(reason))


def common_names(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def by_score_stem(files: DataFrame, name: str = "file") -> DataFrame:
    """One file per cleaned stem; the lexicographically last one wins."""
    keyed = files.withColumn("stem", score_stem(name))
    rest = [c for c in files.columns if c != name]
    best = keyed.groupBy("stem").agg(F.max_by(F.struct(name, *rest), F.col(name)).alias("_f"))
    return best.select("stem", "_f.*")


def match_scores(pred: DataFrame, truth: DataFrame, name: str = "file") -> DataFrame:
    """Prediction and ground truth by cleaned stem; other columns get ``pred_``/``gt_``.

    Only file metadata is deduplicated and shuffled here.
    """
    side = lambda df, p: by_score_stem(df, name).select("stem", *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return side(pred, "pred").join(side(truth, "gt"), "stem")


def size_check(pairs: DataFrame, max_diff: int = 4) -> DataFrame:
    """Adds ``reason``: NULL when the pair is usable.

    Expects ``rgb_h, rgb_w, ir_h, ir_w``; NULL sizes mean an unreadable frame.
    """
    rh, rw, ih, iw = (F.col(c) for c in ("rgb_h", "rgb_w", "ir_h", "ir_w"))
    unreadable = rh.isNull() | rw.isNull() | ih.isNull() | iw.isNull()
    far = (F.abs(ih - rh) > max_diff) | (F.abs(iw - rw) > max_diff)
    text = F.format_string("size mismatch rgb(%d, %d) ir(%d, %d)", rh, rw, ih, iw)
    return pairs.withColumn("reason", F.when(unreadable, F.lit("unreadable")).when(far, text))


def reject_text(session: Column, suffix: Column, file: Column, reason: Column) -> Column:
    return F.concat(session, F.lit("/"), suffix, F.lit("/"), file, F.lit(": "), reason)


def attach_temperature(rows: DataFrame, temps: DataFrame, norm, fallback: Column, spread: Sequence[str] = ("stem",)) -> DataFrame:
    """Condition ``t``: the logged temperature of the stem, else ``fallback``."""
    logged = lookup(rows, temps.select("stem", "celsius"), ["stem"], spread, how="left")
    return logged.withColumn("t", F.coalesce(norm.celsius_to_norm(F.col("celsius")), fallback)).drop("celsius")


def sweep(frames: DataFrame, values: Sequence[float | None]) -> DataFrame:
    """Every frame under every requested condition value.

    The list is a handful of literals, so it is exploded in place: no join.
    """
    wanted = [F.lit(v).cast("double") for v in (values or [None])]
    return frames.withColumn("cond", F.explode(F.array(*wanted)))


def decoupled(rgb: DataFrame, ir: DataFrame, train: bool, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Unpaired partners: a seeded draw in training, ``idx mod n`` otherwise.

    Both sides carry ``name``; IR rows are numbered once and joined on the
    computed index, so no side is collected.
    """
    left = ordered.dense_index(rgb.select(F.col("name").alias("rgb_name")), [], ["rgb_name"], "idx")
    right = ordered.dense_index(ir.select(F.col("name").alias("ir_name")), [], ["ir_name"], "ir_idx", total="n")
    n = right.agg(F.max("n")).scalar()
    draw = hash_choice(n, "rgb_name", epoch, seed) if train else F.pmod(F.col("idx"), n)
    keyed = left.withColumn("ir_idx", draw.cast("bigint"))
    return keyed.join(right.drop("n"), "ir_idx")


def compare_checksums(ours: DataFrame, theirs: DataFrame, key: str, digest: str) -> DataFrame:
    """Verify a copy: ``ok``, ``changed``, ``missing`` or ``extra`` per key."""
    a = ours.select(key, F.col(digest).alias("_a"))
    b = theirs.select(key, F.col(digest).alias("_b"))
    state = (
        F.when(F.col("_b").isNull(), F.lit("missing"))
        .when(F.col("_a").isNull(), F.lit("extra"))
        .when(F.col("_a") == F.col("_b"), F.lit("ok"))
        .otherwise(F.lit("changed"))
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def index_within(rgb: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """Position over *all* RGB names, so skipped pairs leave gaps."""
    return ordered.dense_index(rgb, by, order, name)


def skip_first(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return ordered.dense_index(df, by, order, "idx").where(F.col("idx") >= n)


def size_at_first(frames: DataFrame, by: Sequence[str], order: str = "idx") -> DataFrame:
    """The first frame's size stands for the recording."""
    first = F.min_by(F.struct("height", "width"), F.col(order)).alias("_s")
    return frames.groupBy(*by).agg(first).select(*by, "_s.height", "_s.width")


def not_yet_written(frames: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose target does not exist yet: makes a re-run resume."""
    return frames.join(done.select(*keys), list(keys), "left_anti")
