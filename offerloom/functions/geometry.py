"""Columns over quads: four points (top left, top right, bottom right, bottom left) of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of size and shape within which two quads are the same screen.
SIZE_BAND, SHAPE_BAND = 0.78, 0.70


def point(q: Column, i: int) -> Column:
    return F.get(q, i)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def sides(q: Column) -> Column:
    return F.array(*(distance(point(q, i), point(q, (i + 1) % 4)) for i in range(4)))


def width(q: Column) -> Column:
    return (distance(point(q, 0), point(q, 1)) + distance(point(q, 3), point(q, 2))) / 2


def height(q: Column) -> Column:
    return (distance(point(q, 0), point(q, 3)) + distance(point(q, 1), point(q, 2))) / 2


def span(q: Column) -> Column:
    """A screen's own scale: the mean of its diagonals."""
    return (distance(point(q, 0), point(q, 2)) + distance(point(q, 1), point(q, 3))) / 2


def apart(a: Column, b: Column) -> Column:
    """Mean distance between corresponding corners."""
    return sum((distance(point(a, i), point(b, i)) for i in range(1, 4)), distance(point(a, 0), point(b, 0))) / 4


def aspect(q: Column) -> Column:
    """Height by width."""
    return height(q) / F.greatest(width(q), F.lit(1.0))


def _within(ratio: Column, band: float) -> Column:
    return F.coalesce(ratio.between(band, 1 / band), F.lit(False))


def same_size(a: Column, b: Column) -> Column:
    return _within(span(a) / F.greatest(span(b), F.lit(1.0)), SIZE_BAND)


def same_shape(a: Column, b: Column) -> Column:
    return _within(aspect(a) / F.greatest(aspect(b), F.lit(0.01)), SHAPE_BAND)


def near(a: Column, b: Column, share: float) -> Column:
    """Whether corners lie within a share of b's own scale."""
    return apart(a, b) <= share * F.greatest(span(b), F.lit(1.0))


def contains(q: Column, p: Column) -> Column:
    """Whether a convex quad has a point inside or on its edge: it lies on one side of all edges."""
    side = lambda a, b: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    turns = F.array(*(side(point(q, i), point(q, (i + 1) % 4)) for i in range(4)))
    return (F.array_min(turns) >= 0) | (F.array_max(turns) <= 0)


def centre(q: Column) -> Column:
    mean = lambda c: sum((point(q, i)[c] for i in range(1, 4)), point(q, 0)[c]) / 4
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def area_centre(q: Column) -> Column:
    """Centre of the area of a quad; null if it has none."""
    turn = lambda i: point(q, i)["x"] * point(q, (i + 1) % 4)["y"] - point(q, (i + 1) % 4)["x"] * point(q, i)["y"]
    twice = turn(0) + turn(1) + turn(2) + turn(3)
    along = lambda c: sum(((point(q, i)[c] + point(q, (i + 1) % 4)[c]) * turn(i) for i in range(1, 4)), (point(q, 0)[c] + point(q, 1)[c]) * turn(0)) / (3 * twice)
    return F.when(twice != 0, F.struct(along("x").alias("x"), along("y").alias("y")))


def ease(old: Column, new: Column, share: float = 0.35) -> Column:
    """Corners moved a share of the way."""
    move = lambda a, b: F.struct(*((a[c] + (b[c] - a[c]) * share).alias(c) for c in ("x", "y")))
    return F.zip_with(old, new, move)


def order_corners(points: Column) -> Column:
    """Any four points as a quad: extremes of x + y and y - x."""
    by = lambda key: F.transform(points, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    total, slope = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    xy = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    return F.array(xy(F.array_min(total)), xy(F.array_min(slope)), xy(F.array_max(total)), xy(F.array_max(slope)))


def fraction(x: Column) -> Column:
    """Clipped to 0..1; null if it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


# The least side of a crop and of a box, the edge of a frame, the height of a phone by
# its width, and the part of a screen that a card takes.
LEAST_CROP, LEAST_BOX, EDGE, PHONE_ASPECT, CARD_SHARE, CROP_SLACK = 0.05, 0.08, 0.012, 2.0, 0.5, 0.20


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _extent(points: Column, c: str) -> Column:
    values = F.transform(points, lambda p: p[c])
    return F.array_max(values) - F.array_min(values)


def crop_quad(quad: Column, box: Column) -> Column:
    """``struct<quad,error>`` of a request for a crop: four corners (arrays of x and y), or else x, y, width and height,
    all fractions of the frame; what is wrong with it otherwise."""
    corners = F.transform(quad, lambda p: _xy(fraction(F.get(p, 0)), fraction(F.get(p, 1))))
    pairs = F.forall(quad, lambda p: F.coalesce(F.size(p) == 2, F.lit(False)))
    b = F.transform(box, fraction)
    x, y, w, h = (F.get(b, i) for i in range(4))
    right, low = F.least(F.lit(1.0), x + w), F.least(F.lit(1.0), y + h)
    drawn = F.array(_xy(x, y), _xy(right, y), _xy(right, low), _xy(x, low))
    given = F.when(quad.isNotNull(), corners).when(box.isNotNull(), drawn)
    unknown = F.exists(given, lambda p: p["x"].isNull() | p["y"].isNull())
    error = (
        F.when(quad.isNotNull() & (F.size(quad) != 4), "a quad needs four corners").when(quad.isNotNull() & ~pairs, "each corner is an [x, y] pair")
        .when(quad.isNull() & box.isNotNull() & (F.size(box) != 4), "a box needs x, y, w, h").when(given.isNull(), "expected a box or a quad").when(unknown, "corners must be numbers")
        .when((_extent(given, "x") < LEAST_CROP) | (_extent(given, "y") < LEAST_CROP), "that box is too small to read anything from \u2014 drag a bigger one")
    )
    return F.struct(F.when(error.isNull(), order_corners(given)).alias("quad"), error.alias("error"))


def valid_box(box: Column, least: float = LEAST_BOX) -> Column:
    """The box (x, y, width, height) if it is four usable numbers inside the frame; null otherwise."""
    usable = F.forall(box, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    x, y, w, h = (F.get(box, i) for i in range(4))
    return F.when((F.size(box) == 4) & usable & (w >= least) & (h >= least) & (x >= 0) & (y >= 0) & (x + w <= 1.001) & (y + h <= 1.001), box)


def in_pixels(q: Column, frame_width: Column, frame_height: Column) -> Column:
    return F.transform(q, lambda p: _xy(p["x"] * frame_width, p["y"] * frame_height))


def as_fractions(q: Column, frame_width: Column, frame_height: Column) -> Column:
    """Pixels as fractions; a frame without a side counts as one of 1."""
    side = lambda c: F.when(c != 0, c).otherwise(1.0)
    return F.transform(q, lambda p: _xy(p["x"] / side(frame_width), p["y"] / side(frame_height)))


def describe(q: Column) -> Column:
    """x, y, width and height as text."""
    least = lambda c: F.array_min(F.transform(q, lambda p: p[c]))
    return F.format_string("%.2f %.2f %.2f %.2f", least("x"), least("y"), _extent(q, "x"), _extent(q, "y"))


def touches_edge(q: Column, frame_width: Column, frame_height: Column, margin: float = EDGE) -> Column:
    """``array<string>``: the frame's edges that a screen runs into."""
    low, high = (lambda c, f=f: f(F.transform(q, lambda p: p[c])) for f in (F.array_min, F.array_max))
    mx, my = frame_width * margin, frame_height * margin
    hits = [("top", low("y") <= my), ("bottom", high("y") >= frame_height - 1 - my), ("left", low("x") <= mx), ("right", high("x") >= frame_width - 1 - mx)]
    return F.array_compact(F.array(*(F.when(hit, name) for name, hit in hits)))


def screen_height(q: Column, frame_width: Column, frame_height: Column) -> Column:
    """A screen's height; of one that runs off the frame at least what its width stands for."""
    cut = F.size(touches_edge(q, frame_width, frame_height)) > 0
    return F.when(cut, F.greatest(height(q), width(q) * PHONE_ASPECT)).otherwise(height(q))


def card_share(q: Column, frame_width: Column, frame_height: Column) -> Column:
    """The part of a quad that the card takes."""
    share = screen_height(q, frame_width, frame_height) * CARD_SHARE / height(q)
    return F.when(height(q) > 0, F.least(F.lit(1.0), F.greatest(F.lit(CARD_SHARE), share))).otherwise(CARD_SHARE)


def card_pixels(q: Column, frame_width: Column, frame_height: Column) -> Column:
    return F.bround(screen_height(q, frame_width, frame_height) * CARD_SHARE, 0).cast("long")


def centred_roi(share: Column, slack: float = CROP_SLACK) -> Column:
    """``array<double>``: left, top, width and height of the part to read."""
    tall = F.least(F.lit(1.0), share + slack)
    return F.array(F.lit(0.0), (1.0 - tall) / 2.0, F.lit(1.0), tall)
