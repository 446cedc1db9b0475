"""Decisions of the passes that rewrite documents: what each rule does to which block, without the markup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Cols = Sequence[str]


def emptied(before: DataFrame, after: DataFrame, keys: Cols) -> DataFrame:
    """Paragraphs to remove: empty now and not before, unless something needs them.

    after: keys, id, empty, has_section, only_in_container, last_of_required, between_tables.
    """
    were = before.where("empty").select(*keys, "id")
    free = ~F.col("has_section") & ~F.col("only_in_container") & ~F.col("last_of_required") & ~F.col("between_tables")
    return after.where(F.col("empty") & free).join(were, [*keys, "id"], "left_anti").select(*keys, "id")


def empty_between_tables(blocks: DataFrame, keys: Cols, order: str = "ord") -> DataFrame:
    """Blocks with whether an empty paragraph stands between two tables, or a table and a page break; never the last block."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag("kind").over(w), F.lead("kind").over(w)
    side = (before == "table") & after.isin("table", "page_break")
    return blocks.withColumn("between_tables", F.coalesce((F.col("kind") == "empty") & side, F.lit(False)))


def pictures_above(blocks: DataFrame, keys: Cols, order: str = "ord") -> DataFrame:
    """(keys, ord, table): picture-only paragraphs in an unbroken run right above each table."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Walking up from below: the last table met, and the last block that ends a run.
    df = blocks.withColumn("__table", F.last(F.when(F.col("kind") == "table", F.col(order)), ignorenulls=True).over(w)).withColumn("__break", F.last(F.when(~F.col("kind").isin("table", "picture"), F.col(order)), ignorenulls=True).over(w))
    return df.where((F.col("kind") == "picture") & F.col("__table").isNotNull() & (F.col("__break").isNull() | (F.col("__break") > F.col("__table")))).select(*keys, order, F.col("__table").alias("table"))


def protected_rows(cells: DataFrame, keys: Cols, printable_height: Column) -> DataFrame:
    """Rows to keep together: those that gained a picture, unless their tallest picture is over a page; an unknown height is no reason."""
    rows = cells.groupBy(*keys, "row").agg(F.bool_or("gained").alias("__gained"), F.max("picture_height").alias("__tallest"), F.max(printable_height).alias("__page"))
    return rows.where(F.col("__gained") & ~F.coalesce(F.col("__tallest") > F.col("__page"), F.lit(False))).select(*keys, "row")


def direction(paragraphs: DataFrame, keys: Cols, anchor: Column, order: str = "ord") -> DataFrame:
    """(keys, right_to_left): what the first paragraph that states it says, else the anchor, else left to right."""
    said = F.min_by(F.when(F.col("rtl").isNotNull(), F.col("rtl")), F.when(F.col("rtl").isNotNull(), F.col(order)))
    return paragraphs.groupBy(*keys).agg(F.coalesce(said, F.max(anchor), F.lit(False)).alias("right_to_left"))


def anchor_kind() -> Column:
    """What an anchored object is, from columns ink, graphic, textbox and picture: the first that holds."""
    return F.when(F.col("ink"), "ink_unsupported").when(F.col("graphic"), "graphic_unsupported").when(F.col("textbox"), "textbox").when(F.col("picture"), "picture").otherwise("unsupported")


def anchor_action() -> Column:
    """What becomes of an anchored object: kind, floating, in_cell, behind, paired, panel."""
    kind = anchor_kind()
    box = F.when(F.col("panel"), "table_rows").when(F.col("paired"), "two_cells").when(F.col("floating"), "floating_table").otherwise("inline_table")
    picture = F.when(F.col("in_cell") & F.col("floating"), "inline").when(F.col("behind"), "behind_text").otherwise("keep")
    return F.when(kind == "textbox", box).when(kind == "picture", picture).when(kind == "ink_unsupported", "drop").otherwise("keep")


def shape_route() -> Column:
    """(type, fidelity) of a drawn shape from fill, kind and rectangular."""
    image = F.col("fill") == "bitmap"
    made = F.when(image, "image").when(F.col("kind").isin("polyline", "connector"), "line").when(F.col("kind") == "path", "path").otherwise("shape")
    how = F.when(image, F.when(F.col("rectangular"), "NATIVE").otherwise("FLATTENED")).when(F.col("kind").isin("rectangle", "ellipse", "polyline", "connector"), "NATIVE").when(F.col("kind") == "polygon", "SUBSTITUTED").otherwise("FLATTENED")
    return F.struct(made.alias("type"), how.alias("fidelity"))


def element_rule() -> Column:
    """The handler of an element: hidden, border art and lettering before its type; unknown types fall back."""
    known = F.col("type").isin("text", "image", "shape", "line", "table", "group", "path")
    return F.when(~F.col("visible"), "ignored").when(F.col("border"), "border_tile").when(F.col("wordart") | F.col("parent_wordart"), "wordart").when(known, F.col("type")).otherwise("fallback")


def authored_groups(elements: DataFrame, keys: Cols) -> DataFrame:
    """(keys, layer, authored): layers that are groups their author made.

    One that holds another layer, or whose children reach outside their largest sibling's frame by more than 3 points or
    5 % of it; of equally large siblings the first by id counts. A layer that clips its content is none, if the elements say
    so. elements: keys, id, parent, kind, x, y, w, h, and clip (of a layer, by its id) if known.
    """
    inside = elements.where("parent is not null")
    largest = inside.groupBy(*keys, "parent").agg(F.min_by(F.struct("x", "y", "w", "h"), F.struct(-F.col("w") * F.col("h"), "id")).alias("__big"))
    slack = F.greatest(F.lit(3.0), 0.05 * F.greatest("__big.w", "__big.h"))
    out = (F.col("x") < F.col("__big.x") - slack) | (F.col("y") < F.col("__big.y") - slack) | (F.col("x") + F.col("w") > F.col("__big.x") + F.col("__big.w") + slack) | (F.col("y") + F.col("h") > F.col("__big.y") + F.col("__big.h") + slack)
    joined = inside.join(largest, [*keys, "parent"])
    found = joined.groupBy(*keys, F.col("parent").alias("layer")).agg(F.bool_or((F.col("kind") == "layer") | out).alias("authored"))
    if "clip" not in elements.columns:
        return found
    clipped = elements.where("kind = 'layer' and clip").select(*keys, F.col("id").alias("layer"), F.lit(True).alias("__clip")).distinct()
    return found.join(clipped, [*keys, "layer"], "left").select(*keys, "layer", (F.col("authored") & F.col("__clip").isNull()).alias("authored"))


def kept_groups(members: DataFrame, keys: Cols) -> DataFrame:
    """(keys, group, members): groups of at least two members at any depth, none of them a table. members: keys, group, id, kind."""
    own = members.groupBy(*keys, "group").agg(F.array_sort(F.collect_set("id")).alias("members"), F.bool_or(F.col("kind") == "table").alias("__table"))
    return own.where((F.size("members") >= 2) & ~F.col("__table")).drop("__table")


def list_numbers(paragraphs: DataFrame, keys: Cols, order: str = "ord") -> DataFrame:
    """Paragraphs with the run of their list, and whether its start needs a note.

    Consecutive paragraphs of one preset are a run; an empty one or one without a preset ends it. A start over 1 is
    noted only where no run is open.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    listed = F.col("preset").isNotNull() & (F.col("length") > 0)
    same = listed & F.coalesce(F.lag(listed).over(w), F.lit(False)) & (F.lag("preset").over(w) == F.col("preset"))
    open_ = F.coalesce(F.lag(listed).over(w), F.lit(False))
    df = paragraphs.withColumn("__new", (listed & ~F.coalesce(same, F.lit(False))).cast("int"))
    df = df.withColumn("run", F.when(listed, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return df.withColumn("restart_note", listed & ~open_ & (F.coalesce("start", F.lit(1)) > 1)).drop("__new")


def fallback_removed(nodes: DataFrame, dropped_tags: Sequence[str] = ("Fallback", "ink", "background")) -> DataFrame:
    """Nodes without the subtrees of some tags. nodes have a path of (node, tag), themselves included."""
    return nodes.where(~F.exists("path", lambda p: p["tag"].isin(*dropped_tags)))


def declared_prefixes(ignorable: Column, declared: Column) -> Column:
    """The ignorable prefixes that are declared, as they were listed."""
    return F.concat_ws(" ", F.filter(F.split(F.trim(ignorable), r"\s+"), lambda p: F.array_contains(declared, p)))
