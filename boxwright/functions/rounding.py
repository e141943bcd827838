"""Rounding to decimal places by the exact binary value of a double, as Python's round() does.

Decimal text of a double, which Spark's round and bround go by, may lie on a tie where the double itself does not: 0.7196405 is a
little above it. Here the double times 10^places is split into the rounded product and its error, both exact, so that it is known on
which side of a tie it lies; real ties go to the even neighbour. Every step is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^27 + 1 parts a double into two halves of 26 bits, products of which are exact.
_PARTS = 134217729.0
#: Doubles from here on have no decimals beyond the sixth that could be told apart; larger ones stay.
_WHOLE = 2.0**52


def exact_round(x: Column, places: int, plain: bool = False) -> Column:
    """x, a double, to 0 to 11 decimal places. Null, infinities and NaN stay; a result of -0.0 is 0.0.

    plain: x is a column or field, cheap to read again, so that all stays in generated code.
    """
    if not 0 <= places <= 11:
        raise ValueError("0 to 11 places")
    ten = 10.0**places  # 26 bits or fewer besides its power of two, so that it needs no parting
    x = x.cast("double")

    def rounded(a: Column) -> Column:
        product = a * ten
        high = a * _PARTS - (a * _PARTS - a)
        error = (high * ten - product) + (a - high) * ten
        floor = F.floor(product).cast("double")
        side = product - floor - 0.5
        up = (side > 0) | ((side == 0) & ((error > 0) | ((error == 0) & (floor % 2 != 0))))
        return (floor + F.when(up, 1.0).otherwise(0.0)) / ten

    whole = lambda a: F.when(a < _WHOLE / ten, rounded(a)).otherwise(a)
    signed = lambda a: F.when(a < 0, F.lit(0.0) - whole(-a)).otherwise(whole(a + 0.0))
    # a fold over one value binds it to a variable, so that a long expression for x is computed once
    return signed(x) if plain else F.aggregate(F.array(x), F.lit(0.0), lambda _, a: signed(a))
