"""Expressions over boxes (x0, y0, x1, y1; half-open) and over bbox structs (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Signed overlap of two intervals; a negative one is the gap between them."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def is_bar(w: Column, h: Column, glyph: Column) -> Column:
    """A flat stroke such as a fraction bar."""
    return (w >= 0.8 * glyph) & (h <= 0.45 * glyph) & (w >= 3 * h)


def center_inside(x: Column, y: Column, w: Column, h: Column, g: Column) -> Column:
    """Whether a box's centre lies in a region (edges included)."""
    cx, cy = x + w / 2, y + h / 2
    return (cx >= g["x"]) & (cx <= g["x"] + g["w"]) & (cy >= g["y"]) & (cy <= g["y"] + g["h"])


def overlap_share(x: Column, y: Column, w: Column, h: Column, g: Column) -> Column:
    """Share of a box's own area that lies in a region."""
    zero = F.lit(0)
    ix = F.greatest(zero, overlap(x, x + w, g["x"], g["x"] + g["w"]))
    iy = F.greatest(zero, overlap(y, y + h, g["y"], g["y"] + g["h"]))
    return ix * iy / F.greatest(F.lit(1), w * h)


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def crossing(a: Column, b: Column, margin: Column) -> Column:
    """Whether segments a and b (structs x0, y0, x1, y1) cross at a point at least `margin` from their four ends."""
    ax, ay, bx, by = a["x1"] - a["x0"], a["y1"] - a["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]
    det = ax * by - ay * bx
    t = ((b["x0"] - a["x0"]) * by - (b["y0"] - a["y0"]) * bx) / F.nullif(det, F.lit(0.0))
    u = ((b["x0"] - a["x0"]) * ay - (b["y0"] - a["y0"]) * ax) / F.nullif(det, F.lit(0.0))
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return F.coalesce((t * la >= margin) & ((1 - t) * la >= margin) & (u * lb >= margin) & ((1 - u) * lb >= margin), F.lit(False))


def upscale(w: Column, h: Column, target: float = 250_000, most: float = 2.5) -> Column:
    """Factor by which a crop is enlarged for the model: toward a number of pixels, within a limit, if it matters."""
    factor = F.least(F.lit(most), F.sqrt(F.lit(target) / F.greatest(F.lit(1), w * h)))
    return F.when(factor > 1.05, factor).otherwise(F.lit(1.0))
