"""Assets: names, what is at risk, what may shrink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measure import shrink_scale
from ..functions.text import DRAWABLE, clean_file_name, folded, suffix_of_mime, zero_padded

#: Names that programs give by themselves.
DEFAULT_NAME = r"(?i)\A(?:picture|image|graphic|video|audio|movie|media|object|shape|content placeholder|placeholder|text box|rectangle|group)\s*\d*\z"
#: Pixels and bytes that a picture may have.
MOST_PIXELS, MOST_BYTES = 25_000_000, 50 << 20


def own_name(name: Column) -> Column:
    """The name that an author gave, cleaned and without a media suffix; null for one that a program gave."""
    bare = clean_file_name(F.regexp_replace(name, r"(?i)\.(png|jpe?g|gif|bmp|tiff?|svg|webp|mp[34]|m4[av]|wav|mov|avi|wmv)$", ""))
    return F.when((bare != "") & ~F.rlike(bare, F.lit(DEFAULT_NAME)), bare)


def slide_phrase(slides: Column, width: Column) -> Column:
    """slide 01; slides 01, 02, 03; or slides 01 and 4 more."""
    n = F.size(slides)
    padded = F.transform(slides, lambda s: zero_padded(s, width))
    return F.when(n == 1, F.concat(F.lit("slide "), padded[0])).when(n.between(2, 3), F.concat(F.lit("slides "), F.concat_ws(", ", padded))).when(n > 3, F.concat(F.lit("slides "), padded[0], F.lit(" and "), (n - 1).cast("string"), F.lit(" more")))


def named(assets: DataFrame, deck: str = "deck") -> DataFrame:
    """Assets (deck, id, ord, kind, name, mime, slides) with label and file_name.

    By first slide, then place: those on no slide last. A label is the author's name, else the kind with its number
    among all assets of the kind; from its second use on it is numbered.
    """
    first = F.coalesce(F.array_min("slides"), F.lit(10**9))
    df = assets.withColumn("__first", first)
    kinds = Window.partitionBy(deck, "kind").orderBy("__first", "ord")
    label = F.coalesce(own_name(F.col("name")), F.concat_ws(" ", "kind", F.row_number().over(kinds).cast("string")))
    df = df.withColumn("label", label)
    k = F.row_number().over(Window.partitionBy(deck, folded(F.col("label"))).orderBy("__first", "ord"))
    df = df.withColumn("label", F.when(k > 1, F.concat(F.col("label"), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col("label")))
    width = F.max(F.length(F.array_max("slides").cast("string"))).over(Window.partitionBy(deck))
    phrase = slide_phrase(F.array_sort("slides"), F.coalesce(width, F.lit(1)))
    return df.withColumn("file_name", F.concat(F.concat_ws(" – ", deck, phrase, "label"), suffix_of_mime(F.col("mime")))).drop("__first")


def at_risk(kind: Column, mime: Column) -> Column:
    """Whether an asset will not be drawn by itself. Parameters behind a media type do not count."""
    bare = F.lower(F.trim(F.split(mime, ";")[0]))
    return (kind != "image") | ~F.coalesce(bare.isin(*DRAWABLE), F.lit(False))


def needed_sizes(uses: DataFrame, asset: str = "asset") -> DataFrame:
    """(asset, width, height, unknown): the largest size each picture is drawn at, unknown if any use has no size."""
    return uses.groupBy(asset).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.bool_or(F.col("width").isNull() | F.col("height").isNull()).alias("unknown"))


def picture_plan(pictures: DataFrame) -> DataFrame:
    """Pictures (mime, width, height, bytes, needed_width, needed_height, unknown) with a scale, and the first reason against one."""
    scale = shrink_scale(F.col("width"), F.col("height"), F.col("needed_width"), F.col("needed_height"))
    reason = (
        F.when(~F.coalesce(F.lower("mime").isin("image/png", "image/jpeg"), F.lit(False)), "format")
        .when(F.col("width").isNull() | F.col("height").isNull(), "unreadable")
        .when(F.col("width") * F.col("height") > MOST_PIXELS, "too_many_pixels")
        .when(F.coalesce("unknown", F.lit(True)), "size_unknown")
        .when(scale >= 1, "already_small")
    )
    return pictures.withColumn("reason", reason).withColumn("scale", F.when(reason.isNull(), scale).otherwise(1.0))


def usable(mime: Column, width: Column, height: Column, size: Column, readable: Column) -> Column:
    """as_is, convert or refused: whether a picture can be sent as it is. One whose size isn't stated is converted if it is ``readable``."""
    stated = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return F.when(F.lower(mime).isin(*DRAWABLE) & stated & (width * height <= MOST_PIXELS) & (F.coalesce(size, F.lit(0)) <= MOST_BYTES), "as_is").when(F.coalesce(readable, F.lit(False)), "convert").otherwise("refused")


def videos_to_strip(references: DataFrame) -> DataFrame:
    """(package, target): video parts all of whose references are video references and lie in parts that may be edited.

    references: package, part, target, is_video, editable. A part that may not be edited keeps every video it plays.
    """
    own = references.groupBy("package", "target").agg(F.bool_and("is_video").alias("__all"), F.bool_and("editable").alias("__free"))
    return own.where("__all and __free").select("package", "target")
