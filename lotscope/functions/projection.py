"""Local metric coordinates to longitude and latitude (WGS84)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LambertConic:
    """Lambert conformal conic; the defaults are the public constants of EPSG:2154."""

    e: float = 0.0818191910428158
    n: float = 0.7256077650532687
    c: float = 11754255.426096
    xs: float = 700000.0
    ys: float = 12655612.049876
    lon0: float = 3.0

    def lon(self, x: Column, y: Column) -> Column:
        return F.lit(self.lon0) + F.degrees(F.atan2(x - self.xs, self.ys - y) / self.n)

    def lat(self, x: Column, y: Column) -> Column:
        """From the conformal latitude by its closed series in the eccentricity:
        plain arithmetic that stays inside generated code, no iteration."""
        e2 = self.e**2
        e4, e6, e8 = e2**2, e2**3, e2**4
        a2 = e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360
        a4 = 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520
        a6 = 7 * e6 / 120 + 81 * e8 / 1120
        a8 = 4279 * e8 / 161280
        r = F.hypot(x - self.xs, y - self.ys)
        chi = F.lit(2.0) * F.atan(F.pow(r / self.c, F.lit(-1.0 / self.n))) - math.pi / 2
        return F.degrees(
            chi
            + a2 * F.sin(chi * 2)
            + a4 * F.sin(chi * 4)
            + a6 * F.sin(chi * 6)
            + a8 * F.sin(chi * 8)
        )


LAMBERT93 = LambertConic()
