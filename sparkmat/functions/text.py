"""Small text functions: grids, sizes, stems, log clean-up."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_grid(text: str) -> tuple[int, int]:
    """``PxQ`` with positive numbers."""
    m = re.fullmatch(r"(\d+)x(\d+)", text.strip())
    if not m or not int(m[1]) or not int(m[2]):
        raise ValueError(f"not a grid: {text!r}")
    return int(m[1]), int(m[2])


def parse_size(text: str, total: int) -> int:
    """``N`` entries, or ``N%`` of the total, rounded half up and at least 1 where the share isn't 0."""
    text = text.strip()
    if text.endswith("%"):
        share = Decimal(text[:-1])
        n = int((share * total / 100).to_integral_value(ROUND_HALF_UP))
        return max(n, 1) if share > 0 else n
    return int(text)


def stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1)


def without_colours(line: Column) -> Column:
    """The line without ANSI escape sequences."""
    return F.regexp_replace(line, "\x1b\\[[0-9;]*[A-Za-z]", "")


def timer_values(text: Column) -> Column:
    """``n=2,avg=36.2`` as a map of doubles; a plain number as ``avg`` with n = 1."""
    plain = F.map_from_arrays(F.array(F.lit("n"), F.lit("avg")), F.array(F.lit(1.0), F.regexp_extract(text, r"^\s*([-+0-9.eE]+)", 1).try_cast("double")))
    pairs = F.transform_values(F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("=")), lambda k, v: F.regexp_extract(v, r"^([-+0-9.eE]+)", 1).try_cast("double"))
    return F.when(text.contains("="), pairs).otherwise(plain)


def grid_processes(grid: Column) -> Column:
    """P * Q of a ``PxQ`` column."""
    return F.split(grid, "x")[0].cast("long") * F.split(grid, "x")[1].cast("long")
