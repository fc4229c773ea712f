"""Geohashes as a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the alphabet of geohashes.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(latitude: Column, longitude: Column, precision: int = 7) -> Column:
    """Geohash of a point; null if a coordinate is null. Bits alternate, longitude first.

    Each coordinate is quantised once, to as many bits as the hash has of it, and the bits are picked by shifts.
    """
    bits = 5 * precision
    count = {0: (bits + 1) // 2, 1: bits // 2}
    cells = {}
    for axis, (value, span) in enumerate(((longitude, 180.0), (latitude, 90.0))):
        size = 1 << count[axis]
        cell = F.floor((value.cast("double") + span) / (2 * span) * size).cast("long")
        cells[axis] = F.greatest(F.lit(0).cast("long"), F.least(F.lit(size - 1).cast("long"), cell))
    letters = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for place in range(5 * k, 5 * k + 5):
            axis = place % 2
            bit = F.shiftright(cells[axis], count[axis] - 1 - place // 2).bitwiseAND(F.lit(1).cast("long"))
            code = code * 2 + bit
        letters.append(F.substr(F.lit(ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.concat(*letters))
