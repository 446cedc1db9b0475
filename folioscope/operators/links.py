"""What belongs to what: buttons to macros, recordings to slides, outlines to lettering, text to the pictures beside it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, folded, label_starts_with_word

Cols = Sequence[str]


def buttons_to_macros(buttons: DataFrame, macros: DataFrame, key: str = "workbook") -> DataFrame:
    """Buttons (key, id, assigned, label) with the macro (key, macro) that each starts, or null.

    By the assigned name: what stands after the last dot or exclamation mark, case folded. A button without an assigned
    name takes a workbook's only macro if its label begins with the macro's name as a word.
    """
    bare = lambda c: folded(F.element_at(F.split(F.trim(c), "[!.]"), -1))
    m = macros.select(key, F.col("macro"), folded(F.col("macro")).alias("__name"))
    by_name = buttons.withColumn("__name", bare(F.col("assigned"))).join(m.groupBy(key, "__name").agg(F.min("macro").alias("__named")), [key, "__name"], "left")
    sole = m.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("macro").alias("__sole")).where("__n = 1").drop("__n")
    both = by_name.join(sole, key, "left")
    unassigned = F.trim(F.coalesce("assigned", F.lit(""))) == ""
    return both.select(key, "id", F.when(unassigned, F.when(label_starts_with_word(F.col("label"), F.col("__sole")), F.col("__sole"))).otherwise(F.col("__named")).alias("macro"))


def recordings_to_slides(files: DataFrame, slides: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, slide, name): for each slide of a deck the first file by name that is called after it.

    files: name. slides: stem, slide. A file is "<stem> - slide N" with any dash, or "slide N" alone for any deck.
    """
    bare = F.regexp_replace(base_name(F.col("name")), r"\.[^.]+$", "")
    own = files.select("name", folded(F.trim(F.regexp_extract(bare, r"(?i)\A(.*?)\s*[-‐-―]?\s*slide\s*\d+\z", 1))).alias("__stem"), F.regexp_extract(bare, r"(?i)slide\s*(\d+)\z", 1).try_cast("int").alias("slide")).where("slide is not null")
    wanted = slides.withColumn("__key", folded(F.col(stem)))
    exact = wanted.join(own.withColumnRenamed("__stem", "__key"), ["__key", "slide"])
    alone = wanted.join(own.where("__stem = ''").drop("__stem"), "slide")
    return exact.select(stem, "slide", "name").unionByName(alone.select(stem, "slide", "name")).groupBy(stem, "slide").agg(F.min("name").alias("name"))


def lettering_to_outlines(lettering: DataFrame, outlines: DataFrame, keys: Cols, order: str = "ord") -> DataFrame:
    """(keys, id, outline): each lettering, in drawing order, with the next unused outline of its line colour; null if none is left or it has no extent."""
    colour = folded(F.col("colour"))
    sized = (F.col("w") > 0) & (F.col("h") > 0)
    own = lettering.withColumn("__colour", colour).withColumn("__sized", sized)
    w = Window.partitionBy(*keys, "__colour", "__sized").orderBy(order)
    own = own.withColumn("__k", F.when(F.col("__sized"), F.row_number().over(w)))
    free = outlines.withColumn("__colour", colour)
    free = free.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__colour").orderBy(order))).select(*keys, "__colour", "__k", F.col("id").alias("outline"))
    return own.join(free, [*keys, "__colour", "__k"], "left").select(*keys, "id", "outline")


#: Points between a text and a picture beside it, and the share of a line above which one isn't wrapped around.
WRAP_GAP, WRAP_SHARE = 3.6, 0.6


def text_indents(spans: pd.DataFrame, obstacles: pd.DataFrame, gap: float = WRAP_GAP, most_rounds: int = 5) -> pd.DataFrame:
    """(id, left, right): how far the lines of one box give way to pictures beside them.

    spans: id, top, height, x, w, narrow (the height that a narrowed span takes), and own_left and own_right, indents that
    the author set, if there are any: only what they lack is added. A picture level with a span pushes the side that its
    middle is on; one that would take over 0.6 of the line is not wrapped around. A span that gets narrower gets taller,
    which moves those below, so this goes round until it settles, five times at most; then both of the last rounds count.
    """
    out = spans.sort_values("top").reset_index(drop=True)
    sides = []
    for o in obstacles.itertuples():
        for i, s in enumerate(out.itertuples()):
            if o.right <= s.x or o.left >= s.x + s.w:
                continue
            middle = (o.left + o.right) / 2 >= s.x + s.w / 2
            push = max(0.0, s.x + s.w - o.left + gap) if middle else max(0.0, o.right - s.x + gap)
            if push <= WRAP_SHARE * s.w:
                sides.append((i, o.top, o.bottom, 0.0 if middle else push, push if middle else 0.0))
    own = [(float(getattr(s, "own_left", 0.0) or 0.0), float(getattr(s, "own_right", 0.0) or 0.0)) for s in out.itertuples()]
    left, right = [0.0] * len(out), [0.0] * len(out)
    settled = False
    for _ in range(most_rounds):
        top, new = float(out["top"].min()) if len(out) else 0.0, []
        for i, s in enumerate(out.itertuples()):
            bottom = top + (s.narrow if left[i] or right[i] else s.height)
            level = [(a, b) for k, high, low, a, b in sides if k == i and top < low and bottom > high]
            new.append(tuple(max(0.0, max((x[k] for x in level), default=0.0) - own[i][k]) for k in (0, 1)))
            top = bottom
        settled = new == list(zip(left, right, strict=True))
        if settled:
            break
        before, (left, right) = (left, right), ([x[0] for x in new], [x[1] for x in new])
    if not settled and len(out):
        left, right = [max(x) for x in zip(left, before[0], strict=True)], [max(x) for x in zip(right, before[1], strict=True)]
    return pd.DataFrame({"id": out["id"], "left": left, "right": right})


def wrapped(spans: DataFrame, obstacles: DataFrame, keys: Cols, gap: float = WRAP_GAP) -> DataFrame:
    """text_indents() box by box: the spans of a box and the pictures of its page that touch it."""
    kinds = dict(spans.dtypes)

    def work(key: tuple, s: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        out = text_indents(s, o, gap)
        for name, value in zip(reversed(list(keys)), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"id {kinds['id']}", "left double", "right double"])
    return spans.groupBy(*keys).cogroup(obstacles.groupBy(*keys)).applyInPandas(work, schema)


def clips(pictures: DataFrame, relationships: DataFrame, keys: Cols = ("package", "part")) -> DataFrame:
    """Pictures (keys, id, rid, poster_rid, box, start, stop) that play a sound or a film inside the package, with its part and poster."""
    r = relationships.where(~F.col("external") & F.col("resolved").isNotNull()).select("package", F.col("owner").alias("part"), "id", "resolved")
    media = r.where(F.rlike(F.lower("resolved"), F.lit(r"\.(mp4|mov|avi|wmv|m4v|mp3|wav|m4a|wma)$"))).select(*keys, F.col("id").alias("rid"), F.col("resolved").alias("media"))
    poster = r.select(*keys, F.col("id").alias("poster_rid"), F.col("resolved").alias("poster"))
    out = pictures.join(media, [*keys, "rid"]).join(poster, [*keys, "poster_rid"], "left")
    kind = F.when(F.rlike(F.lower("media"), F.lit(r"\.(mp3|wav|m4a|wma)$")), "audio").otherwise("video")
    return out.withColumn("kind", kind).drop("rid", "poster_rid")


def saved_copies(assets: DataFrame, copies: DataFrame, key: str = "deck") -> DataFrame:
    """(key, asset, part, copy): copies (key, asset, copy) of assets (key, asset, parts) for every part they come from."""
    return assets.select(key, "asset", F.explode("parts").alias("part")).join(copies.select(key, "asset", "copy"), [key, "asset"])
