"""Normalised page boxes: x, y, width, height in 0..1 from the top-left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions.text import let

DIGITS = 5


def _clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def box(left: Column, top: Column, right: Column, bottom: Column, clamp_first: bool = True) -> Column:
    """Box from normalised edges, clamped to the page and rounded; null when it has no area.

    ``clamp_first`` decides whether the area test sees the clamped or the raw edges.
    """

    def build(raw: Column) -> Column:
        edges = F.struct(*[_clamp(raw[n]).alias(n) for n in ("l", "t", "r", "b")])

        def finish(clamped: Column) -> Column:
            tested = clamped if clamp_first else raw
            return F.when(
                (tested["r"] > tested["l"]) & (tested["b"] > tested["t"]),
                F.struct(
                    F.round(clamped["l"], DIGITS).alias("x"),
                    F.round(clamped["t"], DIGITS).alias("y"),
                    F.round(clamped["r"] - clamped["l"], DIGITS).alias("width"),
                    F.round(clamped["b"] - clamped["t"], DIGITS).alias("height"),
                ),
            )

        return let(edges, finish)

    return let(F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b")), build)


def quad_to_box(quad: Column, width: Column, height: Column) -> Column:
    """Axis-aligned box of a polygon given as an array of (x, y) pixel arrays.

    Null without points, on a page without area, or where nothing of the polygon is on the page.
    """
    xs = F.transform(quad, lambda p: F.get(p, F.lit(0)).cast("double"))
    ys = F.transform(quad, lambda p: F.get(p, F.lit(1)).cast("double"))
    complete = F.forall(quad, lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    usable = quad.isNotNull() & (F.size(quad) > 0) & (width > 0) & (height > 0) & complete
    return F.when(
        usable,
        box(F.array_min(xs) / width, F.array_min(ys) / height, F.array_max(xs) / width, F.array_max(ys) / height),
    ).otherwise(F.lit(None).cast(schemas.BBOX))
