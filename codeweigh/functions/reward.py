"""Scalar reward math as column expressions.

``exponential_decay`` is ``(b - b**x) / (b - 1)`` with ``b = a**c``.  ``b``
underflows a double for small ``a`` (``a = 1e-5, c = 100`` gives ``1e-500``), so
it is evaluated as ``(exp(x*L) - exp(L)) / (1 - exp(L))`` with ``L = c*ln(a)``.
After clamping, this agrees with 28-digit decimal arithmetic to about 1e-13.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES (reward definition): decay factor and the clamp applied to
# the normalised length.
DECAY_FACTOR = 100
LENGTH_FLOOR = 1e-5
LENGTH_CEIL = 0.99999


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def normalize(x, x_min, x_max) -> Column:
    """``(x - min) / (max - min)`` in double precision."""
    x, lo, hi = _c(x).cast("double"), _c(x_min).cast("double"), _c(x_max).cast("double")
    return (x - lo) / (hi - lo)


def clamp(x, lo, hi) -> Column:
    """``max(min(x, hi), lo)``; null in, null out."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.least(x, _c(hi)), _c(lo)))


def exponential_decay(x, a, c=DECAY_FACTOR) -> Column:
    """R2: ``(b - b**x) / (b - 1)`` with ``b = a**c``, for ``0 < a < 1``."""
    x, a = _c(x).cast("double"), _c(a).cast("double")
    big_l = _c(c).cast("double") * F.log(a)
    return (F.exp(x * big_l) - F.exp(big_l)) / (1.0 - F.exp(big_l))


def reward(nt, ne, avg_tokens, avg_errors, prompt=None, output=None, factor=DECAY_FACTOR) -> Column:
    """R4 + R5: bounded, length-aware structural reward of one pair.

    ``nt`` = tokens of the output, ``ne`` = structural errors of
    prompt + output.  A null prompt scores 0.0 (the parse of the sample
    fails); a null output or a missing calibration is an error, as in the
    scoring rule being rebuilt.  Rounded to 6 decimals, ``-0.0`` folded to 0.
    """
    a = clamp(normalize(nt, 0, avg_tokens), LENGTH_FLOOR, LENGTH_CEIL)
    x = normalize(ne, 0, avg_errors)
    score = clamp(exponential_decay(x, a, factor), 0.0, 1.0)
    score = F.round(score, 6) + F.lit(0.0)
    checked = F.when(_c(avg_tokens).isNull() | _c(avg_errors).isNull(),
                     F.raise_error(F.lit("reward: calibration missing; run calibrate() first"))
                     .cast("double"))
    if output is not None:
        checked = checked.when(_c(output).isNull(),
                               F.raise_error(F.lit("reward: output is null")).cast("double"))
    if prompt is not None:
        checked = checked.when(_c(prompt).isNull(), F.lit(0.0))
    return checked.otherwise(score)


def keyword_count(sample, keyword: str) -> Column:
    """Non-overlapping occurrences of a literal in ``sample``."""
    quoted = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(_c(sample), F.lit(quoted)).cast("bigint")
