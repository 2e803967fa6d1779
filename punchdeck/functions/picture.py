"""PICTURE strings: category, sign, digits and storage size, as an Arrow-batched function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "category string, signed boolean, int_digits int, frac_digits int, positions int"
PART = re.compile(r"(CR|DB|[A-Z0-9*+\-/,.$¥])(?:\((\d+)\))?")


def parse(picture: str) -> tuple[str, bool, int, int, int]:
    """P scales and takes no place; V and S take none either; any editing symbol takes one."""
    symbols = [(s, int(n or 1)) for s, n in PART.findall(picture.upper())]
    kinds = {s for s, _ in symbols}
    places = sum(n * len(s) for s, n in symbols if s not in ("S", "V", "P"))
    before = after = 0
    point = False
    for s, n in symbols:
        if s == "V" or s == ".":
            point = True
        elif s == "9" or s in ("Z", "*"):
            before, after = (before, after + n) if point else (before + n, after)
    if kinds <= {"9", "S", "V", "P"}:
        return ("NUMERIC" if "9" in kinds else "UNKNOWN", "S" in kinds, before, after, places)
    if kinds <= {"A"}:
        return "ALPHABETIC", False, 0, 0, places
    if kinds & {"X", "A"}:
        return ("ALPHANUMERIC" if kinds <= {"X", "A", "9"} else "ALPHANUMERIC_EDITED"), False, 0, 0, places
    return ("NUMERIC_EDITED" if kinds & {"9", "Z", "*"} else "UNKNOWN"), bool(kinds & {"+", "-", "CR", "DB"}), before, after, places


def _batch(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(v) if v else (None,) * 5 for v in values], columns=["category", "signed", "int_digits", "frac_digits", "positions"])


_batch.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}


def picture(column: str) -> Column:
    return F.pandas_udf(_batch, RESULT)(column)
