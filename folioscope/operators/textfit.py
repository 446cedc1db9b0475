"""Whether text fits a frame, and how far spacing and size must give way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Height of a line in type sizes, insets across and down in points, share of the room that is used.
LEADING, INSET_ACROSS, INSET_DOWN, FILL = 1.2, 7.2, 3.6, 0.97
#: Steps in order: (line spacing in per cent, scale of the type).
STEPS = [(100, 1.0), (95, 1.0), (90, 1.0), *[(90, round(1 - 0.05 * k, 2)) for k in range(1, 6)]]


def wrapped_lines(text: str, size: float, width: float, advance: dict[str, float]) -> int | None:
    """Lines that a paragraph takes, words set greedily; None if a character's width isn't known."""
    space, lines, used = advance.get(" "), 1, 0.0
    for word in text.split(" "):
        if any(c not in advance for c in word) or space is None:
            return None
        long = sum(advance[c] for c in word) * size
        if used and used + space * size + long > width:
            lines, used = lines + 1, 0.0
        used += long + (space * size if used else 0.0)
        while used > width and width > 0:  # a word longer than the line
            lines, used = lines + 1, used - width
    return lines


def fit(paragraphs: list[tuple[str, float]], width: float, height: float, advance: dict[str, float]) -> tuple[int, float, bool] | None:
    """(spacing, scale, overflow) at the first step at which the paragraphs (text, size) fit; None if they can't be measured."""
    room, inner = (height - 2 * INSET_DOWN) * FILL, width - 2 * INSET_ACROSS
    for spacing, scale in STEPS:
        total = 0.0
        for text, size in paragraphs:
            lines = wrapped_lines(text, size * scale, inner, advance)
            if lines is None:
                return None
            total += lines * size * scale * LEADING * spacing / 100
        if total <= room:
            return spacing, scale, False
    return *STEPS[-1], True


def fitted(frames: DataFrame, advance: dict[str, float]) -> DataFrame:
    """frames (id bigint, width, height, paragraphs array of (text, size)) with spacing, scale and overflow; nulls where unmeasurable.

    advance: widths of characters in type sizes, of one font; a table of a few hundred entries.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [fit([(p["text"], p["size"]) for p in r.paragraphs], r.width, r.height, advance) or (None, None, None) for r in rows.itertuples()]
            yield pd.DataFrame({"id": rows["id"], "spacing": pd.array([o[0] for o in out], "Int64"), "scale": pd.array([o[1] for o in out], "Float64"), "overflow": pd.array([o[2] for o in out], "boolean")})

    return frames.select("id", "width", "height", "paragraphs").mapInPandas(work, "id bigint, spacing bigint, scale double, overflow boolean")
