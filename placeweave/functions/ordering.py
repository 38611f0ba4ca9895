"""Numbers that sort as other values do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.cleaning import _col

#: Bits of a double's fraction, the bias of its exponent, and its smallest normal exponent.
_FRACTION, _BIAS, _LEAST = 52, 1023, -1022


def ordered_bits(value: Column | str) -> Column:
    """A long for each double, in the same order, neighbours next to each other; both zeros are 0, NaN is last.

    Exponent and fraction come from exact steps: a logarithm that may be off by one, put right by
    comparison, and divisions by powers of two."""
    v = _col(value).cast("double")
    size = F.abs(v)
    near = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(_LEAST))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when((near > _LEAST) & (two(near) > size), near - 1).when((near < _BIAS) & (two(near + 1) <= size), near + 1).otherwise(near)
    fraction = ((size / two(exponent) - 1) * 2.0 ** _FRACTION).cast("long")
    normal = F.shiftleft((exponent + _BIAS).cast("long"), _FRACTION) + fraction
    small = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    bits = (F.when(F.isnan(v), F.lit((_BIAS * 2 + 1 << _FRACTION) + 1)).when(size == float("inf"), F.lit(_BIAS * 2 + 1 << _FRACTION))
            .when(size < 2.0 ** _LEAST, small).otherwise(normal))
    return F.when(v < 0, -bits).otherwise(bits)
