"""Positions on pages: coincidence, nearest pictures, bands against rows, room below, page relations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measure import overlaps
from .ordered import bands

#: 0.06 in and 3 % for coincidence, 274 320 EMU for bands.
COINCIDENT_EMU, COINCIDENT_SHARE, BAND_EMU = 54_864, 0.03, 274_320


def near_coincident(pictures: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pictures with whether a text box of their paragraph lies on them: offsets and sizes nearly equal."""
    b = boxes.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("x", "y", "w", "h")])
    near = lambda c: F.abs(F.col(c) - F.col(f"__{c}")) <= COINCIDENT_EMU
    like = lambda c: F.abs(F.col(c) - F.col(f"__{c}")) <= COINCIDENT_SHARE * F.greatest(F.col(c), F.col(f"__{c}"))
    hit = pictures.join(b, list(keys)).where(near("x") & near("y") & like("w") & like("h")).select(*keys, "id").distinct().withColumn("coincident", F.lit(True))
    return pictures.join(hit, [*keys, "id"], "left").withColumn("coincident", F.coalesce("coincident", F.lit(False)))


def first_overlap(pictures: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each picture with the first table, in document order, whose box it overlaps. Boxes are structs of x, y, w, h."""
    t = tables.select(*keys, F.col("id").alias("table_id"), F.col("ord").alias("__ord"), F.col("box").alias("__box"))
    both = pictures.join(t, list(keys)).where(overlaps(F.col("box"), F.col("__box")))
    return both.groupBy(*keys, "id").agg(F.min_by("table_id", "__ord").alias("table_id"))


def side_by_side(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left, right): neighbours in reading order that stand side by side, no box in two pairs.

    A box and the next may pair if they overlap vertically and do not horizontally. In a run of boxes that may pair one
    by one, the first goes with the second, the third with the fourth, and so on: greedy, without a loop.
    """
    w = Window.partitionBy(*keys).orderBy("y", "x", "id")
    nxt = lambda c: F.lead(c).over(w)
    may = (F.col("y") < nxt("y") + nxt("h")) & (nxt("y") < F.col("y") + F.col("h")) & (F.col("x") + F.col("w") <= nxt("x"))
    df = boxes.withColumn("__next", nxt("id")).withColumn("__may", F.coalesce(may, F.lit(False)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__stop", F.coalesce(F.max(F.when(~F.col("__may"), F.col("__n"))).over(before), F.lit(0)))
    return df.where(F.col("__may") & ((F.col("__n") - F.col("__stop")) % 2 == 1)).select(*keys, F.col("id").alias("left"), F.col("__next").alias("right"))


def bands_to_rows(pictures: DataFrame, columns: DataFrame, rows: DataFrame, keys: Sequence[str], gap: float = BAND_EMU) -> DataFrame:
    """(keys, id, col, row): each left-over picture of a table in the column that holds it and the free row of its band.

    All or nothing by table: every picture must lie wholly in one column, and each column must have as many bands as
    free rows. columns: keys, col, left, right. rows: keys, col, row. pictures: keys, id, x, y, w.
    """
    inside = pictures.join(columns, list(keys)).where((F.col("x") >= F.col("left")) & (F.col("x") + F.col("w") <= F.col("right")))
    banded = bands(inside, [*keys, "col"], ["y", "id"], F.col("y"), gap, "k")
    free = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "col").orderBy("row")))
    out = banded.join(free, [*keys, "col", "k"], "left")
    per_column = banded.groupBy(*keys, "col").agg(F.max("k").alias("__bands")).join(free.groupBy(*keys, "col").agg(F.max("k").alias("__rows")), [*keys, "col"], "left")
    even = per_column.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("__bands") == F.col("__rows"), F.lit(False))).alias("__even"))
    placed = inside.groupBy(*keys).agg(F.countDistinct("id").alias("__placed"))
    all_ = pictures.groupBy(*keys).agg(F.countDistinct("id").alias("__all"))
    good = even.join(placed, list(keys)).join(all_, list(keys)).where("__even and __placed = __all").select(*keys)
    return out.join(good, list(keys), "left_semi").select(*keys, "id", "col", "row")


def nearest_stills(videos: pd.DataFrame, pictures: pd.DataFrame, tolerance: float = 4.0) -> pd.DataFrame:
    """(video, picture) of one slide: in the videos' order, the unused picture nearest in all four measures together."""
    used, out = set(), []
    for v in videos.sort_values("ord").itertuples():
        gaps = [(abs(p.x - v.x) + abs(p.y - v.y) + abs(p.w - v.w) + abs(p.h - v.h), p.ord, p.id) for p in pictures.itertuples() if p.id not in used and max(abs(p.x - v.x), abs(p.y - v.y), abs(p.w - v.w), abs(p.h - v.h)) <= tolerance]
        if gaps:
            best = min(gaps)
            used.add(best[2])
            out.append((v.id, best[2]))
    return pd.DataFrame(out, columns=["video", "picture"])


def matched_stills(videos: DataFrame, pictures: DataFrame, keys: Sequence[str], tolerance: float = 4.0) -> DataFrame:
    """nearest_stills() slide by slide. Each choice depends on those before it, so a slide is one group; slides are small."""
    kinds = dict(videos.dtypes)

    def work(key: tuple, v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = nearest_stills(v, p, tolerance)
        for name, value in zip(reversed(list(keys)), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"video {kinds['id']}", f"picture {kinds['id']}"])
    return videos.groupBy(*keys).cogroup(pictures.groupBy(*keys)).applyInPandas(work, schema)


#: Fixed value: crops that are tried in every order; of more, only the order as it is.
MOST_PERMUTED = 6


def assigned(uses: list[float], crops: list[float], tolerance: float) -> list[int] | None:
    """For each use the crop that goes with it, by aspect ratio: the first order that fits within the tolerance. None if none does or their numbers differ."""
    if len(uses) != len(crops):
        return None
    own = tuple(range(len(crops)))
    for p in permutations(own) if len(own) <= MOST_PERMUTED else [own]:
        if all(abs(crops[k] / u - 1) <= tolerance for u, k in zip(uses, p, strict=True)):
            return list(p)
    return None


def room_below(elements: DataFrame, keys: Sequence[str], page_height: Column) -> DataFrame:
    """Tables with the height they may grow to: to the page's edge less 10, an enclosing box's bottom, or the top of what is below; their own height at least.

    elements: keys, id, kind, x, y, w, h.
    """
    o = elements.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "w", "h")])
    tables = elements.where("kind = 'table'").withColumn("__edge", page_height - 10)
    both = tables.join(o, list(keys)).where("id <> o_id and x < o_x + o_w and o_x < x + w")
    bottom, top = F.col("y") + F.col("h"), F.col("y")
    encloses = (F.col("o_y") <= top + 1) & (F.col("o_y") + F.col("o_h") >= bottom - 1)
    limit = both.groupBy(*keys, "id").agg(F.min(F.when(encloses, F.col("o_y") + F.col("o_h")).when(F.col("o_y") >= bottom - 1, F.col("o_y"))).alias("__limit"))
    out = tables.join(limit, [*keys, "id"], "left")
    room = F.least(F.col("__edge"), F.coalesce("__limit", "__edge")) - top - 2
    return out.select(*keys, "id", F.greatest(F.col("h"), room).alias("room"))


def in_front(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, front): visible pictures and shapes of the page above each element."""
    o = elements.where("visible and kind in ('image', 'shape') and not border").select(*keys, F.col("id").alias("front"), F.col("z").alias("__z"))
    return elements.join(o, list(keys)).where("__z > z").select(*keys, "id", "front")


def border_groups(elements: DataFrame) -> DataFrame:
    """(page, parent, tiles, box): border art by parent, with the box around its tiles."""
    own = elements.where("border").groupBy("page", "parent")
    return own.agg(F.count(F.lit(1)).alias("tiles"), F.struct(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h")).alias("box"))


def grid_edges(columns: DataFrame, keys: Sequence[str], start: Column) -> DataFrame:
    """Columns with their left and right edges, from widths and a start."""
    w = Window.partitionBy(*keys).orderBy("col")
    right = start + F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return columns.withColumn("right", right).withColumn("left", F.col("right") - F.col("width"))


def page_relation(pairs: DataFrame, marks: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """pairs (key, a, b: places, a <= b) with ``relation``: same, different or unknown page.

    marks: key, place, inside, before, ends (counts of page-break marks in, at the start and at the end of a block) and
    rendered (whether the document records breaks at all). Any mark between is a difference; one inside either end
    leaves it open; without recorded breaks, so does a distance over ``limit``.
    """
    total = F.col("inside") + F.col("before") + F.col("ends")
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = marks.withColumn("__sum", F.sum(total).over(w)).withColumn("__own", total)
    side = lambda s: m.select(key, F.col("place").alias(s), *[F.col(c).alias(f"{s}_{c.strip('_')}") for c in ("inside", "before", "ends", "__sum", "__own", "rendered")])
    both = pairs.join(side("a"), [key, "a"]).join(side("b").drop("b_rendered"), [key, "b"])
    between = F.col("b_sum") - F.col("b_own") - F.col("a_sum")
    relation = (
        F.when(F.col("a") == F.col("b"), F.when(F.col("a_inside") > 0, "unknown").otherwise("same"))
        .when((between > 0) | (F.col("a_ends") > 0) | (F.col("b_before") > 0), "different")
        .when((F.col("a_inside") > 0) | (F.col("b_inside") > 0), "unknown")
        .when(~F.col("a_rendered") & (F.col("b") - F.col("a") > limit), "unknown")
        .otherwise("same")
    )
    return both.select(*pairs.columns, relation.alias("relation"))


def reading_order(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slots of a paragraph with the object each should hold: by (y, x) where all share one frame and have offsets, else as they are."""
    all_ = Window.partitionBy(*keys)
    sortable = (F.min("frame").over(all_) == F.max("frame").over(all_)) & (F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(all_) == F.count(F.lit(1)).over(all_))
    df = slots.withColumn("__sort", F.coalesce(sortable, F.lit(False))).withColumn("__slot", F.row_number().over(all_.orderBy("slot")))
    by_place = F.row_number().over(all_.orderBy("y", "x", "slot"))
    ranked = df.withColumn("__place", F.when(F.col("__sort"), by_place).otherwise(F.col("__slot")))
    to = ranked.select(*keys, F.col("__place").alias("__slot"), F.col("id").alias("object"))
    return ranked.select(*keys, "slot", "__slot").join(to, [*keys, "__slot"]).select(*keys, "slot", "object")
