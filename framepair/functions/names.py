"""File-name rules: stems, session keys, output names, condition labels, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm

# Image file extensions.
IMAGE_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def is_image(name: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(_c(name), r"[^/]\.([^./]+)$", 1))
    return ext.isin(*IMAGE_EXTENSIONS)


def stem(name: Column | str) -> Column:
    """Name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(_c(name), r"^(\.*[^.].*)\.[^.]*$", "$1")


def score_stem(name: Column | str) -> Column:
    """Stem with every ``_16bit`` marker removed, as used to match scores."""
    return F.replace(stem(name), F.lit("_16bit"), F.lit(""))


def clean_suffix(suffix: Column | str) -> Column:
    return F.regexp_replace(_c(suffix), r"^[-_]+", "")


def frame_name(n: Column) -> Column:
    return F.format_string("%06d.png", n)


def session_frame_name(session: Column | str, suffix: Column | str, n: Column) -> Column:
    """``<session>[_<suffix>]_<index>.png``; an empty suffix leaves no gap."""
    sfx = F.when(_c(suffix) != "", _c(suffix))
    return F.concat_ws("_", _c(session), sfx, frame_name(n))


def session_of(name: Column | str) -> Column:
    key = F.regexp_extract(_c(name), r"^(.+?)_\d{6}\.png$", 1)
    return F.when(key != "", key)


def number_label(t: Column) -> Column:
    """Shortest text of a number with at most six significant digits (plain notation)."""
    magnitude = F.floor(F.log10(F.abs(t)))
    digits = F.greatest(F.lit(0), F.least(F.lit(12), F.lit(5) - F.coalesce(magnitude, F.lit(0)))).cast("int")
    rounded = F.when(t == 0, F.lit(0.0)).otherwise(F.rint(t * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    text = F.format_string("%.12f", rounded)
    return F.when(t.isNotNull(), F.regexp_replace(text, r"\.?0+$", ""))


def condition(norm: ThermalNorm, t: Column | str) -> tuple[Column, Column]:
    """(normalised condition, folder label) of a requested condition; NULL means none."""
    t = _c(t).cast("double")
    if norm.mode == "abs16":
        value, label = norm.celsius_to_norm(t), F.concat(F.lit("T"), number_label(t), F.lit("C"))
    else:
        value, label = t * 2.0 - 1.0, F.concat(F.lit("T"), number_label(t))
    return F.coalesce(value, F.lit(0.0)), F.coalesce(label, F.lit(""))


def parse_list(text: Column | str, kind: str = "string") -> Column:
    """Comma list to an array, blanks dropped, items trimmed."""
    items = F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return items if kind == "string" else F.transform(items, lambda x: x.cast(kind))


def numeric_order(name: Column | str) -> list[Column]:
    """Sort keys: all-digit stems first by value, then the others by text.

    The value is kept as DECIMAL(38, 0), so long digit runs still sort.
    """
    s = stem(name)
    digits = s.rlike(r"^[0-9]+$")
    return [
        F.when(digits, F.lit(0)).otherwise(F.lit(1)),
        F.when(digits, s.try_cast("decimal(38,0)")),
        F.when(~digits, s),
        _c(name),
    ]
