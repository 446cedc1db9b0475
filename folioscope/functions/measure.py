"""Units, rounding and plane geometry over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English Metric Units.
EMU_PER_POINT, EMU_PER_INCH, EMU_PER_MM, TWIPS_PER_POINT = 12_700, 914_400, 36_000, 20


def half_even(x: Column, places: int = 0) -> Column:
    """Rounded half to even at a decimal place, by scaling first."""
    return F.rint(x * 10**places) / 10**places


def points_to_emu(x: Column) -> Column:
    return F.rint(x * EMU_PER_POINT).cast("long")


def emu_to_points(x: Column) -> Column:
    return x / EMU_PER_POINT


def emu_to_mm(x: Column) -> Column:
    return x / EMU_PER_MM


def degrees(rot: Column) -> Column:
    """Degrees of a stored rotation, 60 000 to a degree."""
    return rot / 60_000


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def contains(outer: Column, inner: Column, slack: float = 0) -> Column:
    """Whether the inner box lies in the outer one, give or take ``slack`` on each side."""
    return (inner["x"] >= outer["x"] - slack) & (inner["y"] >= outer["y"] - slack) & (inner["x"] + inner["w"] <= outer["x"] + outer["w"] + slack) & (inner["y"] + inner["h"] <= outer["y"] + outer["h"] + slack)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def in_group(space: Column, offset: Column, extent: Column, child_offset: Column, child_extent: Column) -> Column:
    """The space (sx, sy, dx, dy) inside a group, from the space around it. A side without child extent keeps its scale."""
    kx = F.when(child_extent["x"] != 0, extent["x"] / child_extent["x"]).otherwise(1.0)
    ky = F.when(child_extent["y"] != 0, extent["y"] / child_extent["y"]).otherwise(1.0)
    return F.struct(
        (space["sx"] * kx).alias("sx"),
        (space["sy"] * ky).alias("sy"),
        (space["dx"] + space["sx"] * (offset["x"] - kx * child_offset["x"])).alias("dx"),
        (space["dy"] + space["sy"] * (offset["y"] - ky * child_offset["y"])).alias("dy"),
    )


def signed_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y): negative if it winds clockwise in a plane whose y goes up."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.aggregate(cross, F.lit(0.0), lambda a, x: a + x) / 2).otherwise(0.0)


def bounds(points: Column) -> Column:
    """The box around an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def largest_step(fits: callable, top: Column, floor: float, step: float) -> Column:
    """The largest of top, top - step, ... not under ``floor`` for which ``fits`` holds; null if none."""
    n = F.greatest(F.floor((top - floor) / step), F.lit(-1)).cast("int")
    sizes = F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: top - k * step))
    return F.array_max(F.filter(sizes, fits))


def shrink_scale(width: Column, height: Column, needed_width: Column, needed_height: Column, least_saving: float = 0.1) -> Column:
    """How far a picture may shrink for its largest use; 1 where the saving is too small."""
    scale = F.least(F.lit(1.0), F.greatest(needed_width / width, needed_height / height))
    return F.when(scale <= 1 - least_saving, scale).otherwise(1.0)


#: Points in a unit of length.
POINTS = {"in": 72.0, "pt": 1.0, "mm": 72 / 25.4, "cm": 72 / 2.54, "pc": 12.0, "px": 0.75, "emu": 1 / 12_700, "twip": 0.05}


def length_in_points(text: Column) -> Column:
    """Points of a length such as 0.39in; null for what isn't one, a percentage among them. A bare number is in twips."""
    number = F.regexp_extract(text, r"\A\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s*([a-zA-Z]*)\s*\z", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"\A\s*(?:[+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s*([a-zA-Z]*)\s*\z", 1))
    factor = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    return F.when(unit == "", number / TWIPS_PER_POINT).otherwise(number * factor[unit])


def percentage(text: Column) -> Column:
    """115.0 for 115%; null for anything else."""
    return F.regexp_extract(text, r"\A\s*([+-]?\d+(?:\.\d+)?)\s*%\s*\z", 1).try_cast("double")


def eased(p: Column, accel: Column, decel: Column) -> Column:
    """Progress at share p of the time, with a speed-up over the first ``accel`` and a slow-down over the last ``decel``.

    The area under a trapezoid of speed, so that it ends at 1. Shares outside of 0 to 1 count as these.
    """
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    total = accel + decel
    top = 1 / (1 - total / 2)
    ramp_up = 0.5 * top * p * p / accel
    ramp_down = 1 - 0.5 * top * (1 - p) * (1 - p) / decel
    return F.when(total <= 0, p).when((accel > 0) & (p < accel), ramp_up).when((decel > 0) & (p > 1 - decel), ramp_down).otherwise(top * (p - accel / 2))


def keyframe_value(frames: Column, at: Column) -> Column:
    """The value at a time of frames (at, value), sorted: linear between, held at both ends; null without frames."""
    before = F.try_element_at(F.filter(frames, lambda f: f["at"] <= at), F.lit(-1))
    after = F.try_element_at(F.filter(frames, lambda f: f["at"] > at), F.lit(1))
    share = (at - before["at"]) / (after["at"] - before["at"])
    return F.when(before.isNull(), after["value"]).when(after.isNull(), before["value"]).otherwise(before["value"] + share * (after["value"] - before["value"]))


def point_along(points: Column, share: Column) -> Column:
    """The point at a share of a polyline's length; null without points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d")))
    goal = share * F.aggregate(steps, F.lit(0.0), lambda s, x: s + x["d"])
    start = F.struct(F.lit(0.0).alias("gone"), points[0]["x"].cast("double").alias("x"), points[0]["y"].cast("double").alias("y"))

    def walk(acc: Column, s: Column) -> Column:
        part = F.when(s["d"] > 0, F.least(F.greatest((goal - acc["gone"]) / s["d"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        on = acc["gone"] <= goal
        return F.struct((acc["gone"] + s["d"]).alias("gone"), F.when(on, s["a"]["x"] + part * (s["b"]["x"] - s["a"]["x"])).otherwise(acc["x"]).cast("double").alias("x"), F.when(on, s["a"]["y"] + part * (s["b"]["y"] - s["a"]["y"])).otherwise(acc["y"]).cast("double").alias("y"))

    return F.when(F.size(points) > 0, F.aggregate(steps, start, walk, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"))))


def frame_of_outline(points: Column) -> Column:
    """Centre, size and rotation in degrees of a rectangle from its four corners in turn."""
    a, b, d = points[0], points[1], points[3]
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / 4
    return F.struct(mean("x").alias("cx"), mean("y").alias("cy"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("w"), F.hypot(d["x"] - a["x"], d["y"] - a["y"]).alias("h"), F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])).alias("rotation"))


def outline_of_frame(frame: Column) -> Column:
    """The four corners of a rotated frame (cx, cy, w, h, rotation), from the upper left on."""
    c, s = F.cos(F.radians(frame["rotation"])), F.sin(F.radians(frame["rotation"]))
    corner = lambda sx, sy: F.struct((frame["cx"] + c * sx * frame["w"] / 2 - s * sy * frame["h"] / 2).alias("x"), (frame["cy"] + s * sx * frame["w"] / 2 + c * sy * frame["h"] / 2).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def paper_offset(frame: Column, align: Column, offset: Column, size: Column, page: Column, low: Column, high: Column) -> Column:
    """Distance from the paper's edge of something placed in a frame: page, margin, left or right margin strip.

    low, high: the margins. By alignment if it is stated, else by offset. Null where the frame or the alignment is not
    known here, as inside and outside, which depend on the page's side.
    """
    start = F.when(frame == "page", F.lit(0)).when(frame == "margin", low).when(frame == "left_margin", F.lit(0)).when(frame == "right_margin", page - high)
    wide = F.when(frame == "page", page).when(frame == "margin", page - low - high).when(frame == "left_margin", low).when(frame == "right_margin", high)
    by_align = F.when(align.isin("left", "top"), start).when(align == "center", start + (wide - size) / 2).when(align.isin("right", "bottom"), start + wide - size)
    return F.when(align.isNotNull(), by_align).otherwise(start + offset)


def shrunk(widths: Column, usable: Column) -> Column:
    """Widths in proportion so that they fill no more than is usable, rounded half to even, 1 at least."""
    total = F.aggregate(widths, F.lit(0.0), lambda s, w: s + w)
    return F.transform(widths, lambda w: F.when(total > usable, F.greatest(F.lit(1), F.rint(w * usable / total))).otherwise(w).cast("long"))
