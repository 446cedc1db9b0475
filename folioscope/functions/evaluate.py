"""Arithmetic formulas of animations, evaluated without running anything from the data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_PART = re.compile(r"\s*(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|#\w+|[()+\-*/])")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}


def evaluate(formula: str | None, variables: dict[str, float]) -> float | None:
    """The value of a formula of numbers, #variables, + - * / and parentheses; None if it is malformed.

    An unknown variable counts as 0, and so does a division by 0. Two stacks: values, and operators that wait for a
    weaker one.
    """
    if formula is None:
        return None
    values: list[float] = []
    waiting: list[str] = []

    def settle(rank: int) -> bool:
        while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= rank:
            op = waiting.pop()
            if len(values) < (1 if op == "neg" else 2):
                return False
            b = values.pop()
            if op == "neg":
                values.append(-b)
                continue
            a = values.pop()
            values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if b else 0.0)
        return True

    at, operand = 0, True  # whether an operand comes next
    text = formula.rstrip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None
        part, at = m[1], m.end()
        if operand:
            if part == "-":
                waiting.append("neg")
            elif part == "(":
                waiting.append("(")
            elif part in _RANK or part == ")":
                return None
            else:
                values.append(variables.get(part[1:], 0.0) if part[0] == "#" else float(part))
                operand = False
        elif part == ")":
            if not settle(1) or not waiting:
                return None
            waiting.pop()
        elif part in _RANK:
            if not settle(_RANK[part]):
                return None
            waiting.append(part)
            operand = True
        else:
            return None
    if operand or not settle(1) or waiting or len(values) != 1:
        return None
    return values[0]


@F.pandas_udf(DoubleType())
def _evaluated(formula: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([evaluate(f, {"ppt_w": w, "ppt_h": h}) for f, w, h in zip(formula, width, height, strict=True)], dtype="float64")


def evaluated(formula: Column, width: Column, height: Column) -> Column:
    """A formula's value for an object of the given size, as shares of the page."""
    return _evaluated(formula, width, height)
