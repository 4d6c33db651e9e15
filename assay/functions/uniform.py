"""Hash uniforms: random draws that depend on a row key only.

A draw is a hash of (seed, op, column, key), so it does not depend on partitioning or on task
retries. Two generators:

- `xxhash64`: one JVM hash of 64 bits per draw, inside generated code. For large tables.
- `md5`: slices of md5(seed|op|column|key), which any SQL engine can repeat. One digest holds four
  independent draws. Costs about five times as much.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATORS = ("xxhash64", "md5")
SLICES = 4
_SPAN = 2**32


def row_key(columns: Sequence[str]) -> Column:
    """The text key of a row. The columns should identify the row and hold no nulls:
    rows with equal keys share their draws."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def digest(seed: int, op: str, column: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{op}|{column}|"), key).cast("binary"))


def _slice_int(dig: Column, n: int) -> Column:
    return F.conv(F.substring(dig, 8 * n + 1, 8), 16, 10).cast("bigint")


def slice_uniform(dig: Column, n: int = 0) -> Column:
    """Slice `n` (0 to 3) of a digest as a double in [0, 1)."""
    return _slice_int(dig, n) / F.lit(float(_SPAN))


def slice_hit(dig: Column, rate: float, n: int = 0) -> Column:
    """`slice_uniform(dig, n) < rate`, as one comparison of texts.

    Hex digits sort like the numbers they write, so no digest is decoded on the way.
    """
    edge = math.ceil(rate * _SPAN)
    if edge <= 0:
        return F.lit(False)
    if edge >= _SPAN:
        return F.lit(True)
    return (F.substring(dig, 8 * n + 1, 32) if n else dig) < F.lit(f"{edge:08x}")


@dataclass(frozen=True)
class Draws:
    """The numbered draws of one operation on the rows with the given key."""

    generator: str
    seed: int
    op: str
    key: Column
    column: str = ""

    def __post_init__(self) -> None:
        if self.generator not in GENERATORS:
            raise ValueError(f"no such generator: {self.generator!r}")

    def helpers(self, count: int) -> dict[str, Column]:
        """Columns to add to the frame before the first `count` draws can be used in `hit`."""
        if self.generator != "md5":
            return {}
        return {
            self._helper(i): digest(self.seed, self.op, str(i), self.key)
            for i in range(-(-count // SLICES))
        }

    def _helper(self, i: int) -> str:
        return f"__{self.op}_{i}"

    def _hash(self, n: int) -> Column:
        """53 bits of a hash as a double in [0, 1)."""
        tag = F.lit(f"{self.seed}|{self.op}|{self.column}|{n}")
        return F.shiftrightunsigned(F.xxhash64(tag, self.key), 11) * F.lit(2.0**-53)

    def hit(self, n: int, rate: float) -> Column:
        """Whether draw `n` is below the rate."""
        if self.generator == "md5":
            return slice_hit(F.col(self._helper(n // SLICES)), rate, n % SLICES)
        return self._hash(n) < F.lit(float(rate))

    def uniform(self, n: int = 0) -> Column:
        """Draw `n` in [0, 1), without helpers: for the few rows that were hit."""
        if self.generator == "md5":
            return slice_uniform(digest(self.seed, self.op, self.column, self.key), n)
        return self._hash(n)

    def normal(self) -> Column:
        """A standard normal draw (Box-Muller); the first uniform is mapped to (0, 1]."""
        if self.generator == "md5":
            dig = digest(self.seed, self.op, self.column, self.key)
            first = (_slice_int(dig, 0) + 1) / F.lit(float(_SPAN))
        else:
            first = F.lit(1.0) - self._hash(0)
        return F.sqrt(F.log(first) * -2.0) * F.cos(F.lit(2 * math.pi) * self.uniform(1))
