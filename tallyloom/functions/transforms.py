"""String transforms of a pair of operands, by name and in order of preference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def interleave(a: Column, b: Column) -> Column:
    """Characters in turn, ``a`` first; the longer tail follows."""
    n = F.greatest(F.length(a), F.length(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(steps, lambda i: F.concat(F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1)))), "")


TRANSFORMS: dict[str, Callable[[Column, Column], Column]] = {
    "forward_concat": lambda a, b: F.concat(a, b),
    "reverse_concat": lambda a, b: F.concat(b, a),
    "reverse_left": lambda a, b: F.concat(F.reverse(a), b),
    "reverse_right": lambda a, b: F.concat(a, F.reverse(b)),
    "reverse_both": lambda a, b: F.concat(F.reverse(a), F.reverse(b)),
    "interleave_lr": interleave,
    "interleave_rl": lambda a, b: interleave(b, a),
}


def apply_rule(rule: Column, left: Column, right: Column) -> Column:
    """The transform that a rule's last segment names, else plain concatenation."""
    name = F.element_at(F.split(rule, ":"), -1)
    out = F.when(F.lit(False), F.lit(""))
    for known, fn in TRANSFORMS.items():
        out = out.when(name == known, fn(left, right))
    return out.otherwise(F.concat(left, right))
