"""Scores over pairs, frames and stored model outputs.

Structural similarity and correlation are kernels (``functions.kernels``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm
from framepair.functions.pixels import abs_error, array_mean

MSE_FLOOR = 1e-12


# -- per frame ------------------------------------------------------------
def l1(a, b) -> Column:
    return array_mean(abs_error(a, b))


def mse(a, b) -> Column:
    return array_mean(F.transform(abs_error(a, b), lambda d: d * d))


def psnr(mean_square: Column) -> Column:
    """Peak 1.0, with the error floored: at most 120 dB."""
    return F.lit(10.0) * F.log10(F.lit(1.0) / F.greatest(mean_square, F.lit(MSE_FLOOR)))


# -- per set --------------------------------------------------------------
def summarise(scored: DataFrame, norm: ThermalNorm, by: Sequence[str] = ()) -> DataFrame:
    """Means of the per-frame ``l1, rmse, psnr, ssim``, plus degrees in abs16."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(c.upper()) for c in ("l1", "rmse", "psnr", "ssim") if c in scored.columns]
    out = scored.groupBy(*by).agg(*aggs)
    if norm.mode == "abs16":
        out = out.withColumn("L1_degC", F.col("L1") * norm.celsius_span)
        out = out.withColumn("RMSE_degC", F.col("RMSE") * norm.celsius_span)
    return out


def verdict(mean_r: Column) -> Column:
    """Reading of the mean luminance correlation; an undefined mean is decoupled."""
    return (
        F.when(mean_r > 0.75, F.lit("shortcut"))
        .when(mean_r > 0.5, F.lit("partial"))
        .otherwise(F.lit("decoupled"))
    )


def capped_validation(batch_scores: DataFrame, max_batches: int, norm: ThermalNorm, by: Sequence[str] = ()) -> DataFrame:
    """Sample-weighted mean over the first batches: ``batch_id, l1, n`` in, [-1, 1] scale."""
    kept = batch_scores.where(F.col("batch_id") < max_batches) if max_batches else batch_scores
    total = F.greatest(F.lit(1), F.sum("n"))
    out = kept.groupBy(*by).agg((F.sum(F.col("l1") * F.col("n")) / total).alias("l1_norm"), F.sum("n").alias("n"))
    return out.withColumn("l1_degC", F.col("l1_norm") * norm.celsius_span / 2.0 if norm.mode == "abs16" else F.lit(None).cast("double"))


# -- stored model outputs -------------------------------------------------
def adversarial_term(logit: Column, target: Column, kind: str = "lsgan") -> Column:
    """One logit's contribution: squared error, or stable cross-entropy on logits."""
    if kind == "lsgan":
        return (logit - target) * (logit - target)
    if kind == "vanilla":
        return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    raise ValueError(f"unknown adversarial score {kind!r}")


def adversarial(logits: DataFrame, by: Sequence[str], kind: str = "lsgan", scale: str | None = None) -> DataFrame:
    """Mean score per group; with ``scale``, the mean of the per-scale means."""
    term = adversarial_term(F.col("logit"), F.col("target"), kind)
    if scale is None:
        return logits.groupBy(*by).agg(F.avg(term).alias("score"))
    per_scale = logits.groupBy(*by, scale).agg(F.avg(term).alias("_s"))
    return per_scale.groupBy(*by).agg(F.avg("_s").alias("score"))


def kl(mu: Column, logvar: Column) -> Column:
    return F.lit(-0.5) * F.avg(F.lit(1.0) + logvar - mu * mu - F.exp(logvar))


def level_consistency(base: Column, t: Column) -> Column:
    """Mean distance between each predicted base's mean level and its condition."""
    return F.avg(F.abs(base - t))


def generator_objective(mode: str, terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of aggregate terms.

    ``single``: gan + l1. ``two_stage``: gan and l1 of both stages, level
    consistency and (when present) KL. ``cycle``: two gan terms, two cycle
    terms and two identity terms.
    """
    w = {"l1": 100.0, "temp": 10.0, "kl": 0.01, "cyc": 10.0, "idt": 5.0, **weights}
    t = lambda name: terms.get(name, F.lit(0.0))
    if mode == "single":
        return t("gan") + t("l1") * w["l1"]
    if mode == "two_stage":
        return t("gan1") + t("gan2") + (t("l1_1") + t("l1_2")) * w["l1"] + t("temp") * w["temp"] + t("kl") * w["kl"]
    if mode == "cycle":
        return t("gan_ab") + t("gan_ba") + (t("cyc_a") + t("cyc_b")) * w["cyc"] + (t("idt_a") + t("idt_b")) * w["idt"]
    raise ValueError(f"unknown objective {mode!r}")


def discriminator_objective(fake: Column, real: Column) -> Column:
    return (fake + real) * 0.5
