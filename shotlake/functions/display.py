"""Display and transfer math as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: SMPTE ST 2084 constants m1, m2, c1, c2, c3; PU21 parameters; display model
PQ = (0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875)
PU21 = (0.353487901, 0.3734658629, 8.277049286e-05, 0.9062562627, 0.09150303166, 0.9099517204, 596.3148142)
PEAK_PQ = 1000.0
SDR_WHITE = 200.0
# fixed values: R'G'B' from Y'CbCr, then luminance weights
BT2020 = ((1.4746,), (0.16455, 0.57135), (1.8814,), (0.2627, 0.6780, 0.0593))
BT709 = ((1.5748,), (0.1873, 0.4681), (1.8556,), (0.2126, 0.7152, 0.0722))


def _held(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def eotf(code: Column, trc: Column) -> Column:
    """Display luminance (cd/m2) of a non-linear value in [0, 1]."""
    e = _held(code, 0.0, 1.0)
    m1, m2, c1, c2, c3 = PQ
    p = F.pow(e, F.lit(1 / m2))
    pq = F.least(F.lit(PEAK_PQ), F.lit(10000.0) * F.pow(
        F.greatest(p - F.lit(c1), F.lit(0.0)) / (F.lit(c2) - F.lit(c3) * p), F.lit(1 / m1)))
    curve = F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12)
    hlg = F.lit(1000.0) * F.pow(curve, F.lit(1.2))
    return F.when(trc == "smpte2084", pq).when(trc == "arib-std-b67", hlg).otherwise(
        F.lit(SDR_WHITE) * F.pow(e, F.lit(2.4)))


def luminance(y: Column, u: Column, v: Column, trc: Column, bt2020: Column) -> Column:
    """Display luminance of 10-bit Y'CbCr codes."""
    luma, cb, cr = (y - 64) / 876, (u - 512) / 896, (v - 512) / 896

    def mix(m) -> Column:
        (r,), (gb, gr), (b,), (kr, kg, kb) = m
        return (F.lit(kr) * eotf(luma + F.lit(r) * cr, trc)
                + F.lit(kg) * eotf(luma - F.lit(gb) * cb - F.lit(gr) * cr, trc)
                + F.lit(kb) * eotf(luma + F.lit(b) * cb, trc))

    return F.when(bt2020, mix(BT2020)).otherwise(mix(BT709))


def pq_encode(lum: Column) -> Column:
    m1, m2, c1, c2, c3 = PQ
    y = F.pow(_held(lum, 0.0, 10000.0) / 10000, F.lit(m1))
    return F.pow((F.lit(c1) + F.lit(c2) * y) / (1 + F.lit(c3) * y), F.lit(m2))


def pu21_encode(lum: Column) -> Column:
    p = PU21
    x = F.pow(_held(lum, 0.005, 10000.0), F.lit(p[3]))
    return F.lit(p[6]) * (F.pow((F.lit(p[0]) + F.lit(p[1]) * x) / (1 + F.lit(p[2]) * x), F.lit(p[4])) - F.lit(p[5]))


def unit_log(lum: Column, units: str, gamma: float = 0.0) -> Column:
    """log10 of d(unit)/d(ln L): what turns a Weber contrast into the unit."""
    if units == "weber":
        return F.lit(0.0)
    if units == "pow":
        return F.lit(float(gamma)) * F.log10(lum / 100.0)
    encode = {"pq": lambda x: pq_encode(x) * 876, "pu21": pu21_encode}[units]
    step = 1.02
    slope = (encode(lum * step) - encode(lum / step)) / F.lit(2 * math.log(step))
    return F.log10(F.greatest(slope, F.lit(1e-12)))


def band_freq(band: Column, ppd: Column) -> Column:
    """Centre frequency of a pyramid band: half the pixel density, then 0.3228 of it halving per band."""
    share = F.when(band == 0, F.lit(1.0)).otherwise(F.lit(0.3228) * F.pow(F.lit(2.0), 1 - band))
    return share * ppd / 2


def bin_centre(index: Column, start: float, step: float, n_edges: int) -> Column:
    """Centre of a histogram bin over `n_edges` uniform edges; the open ends sit half a step outside."""
    return F.lit(start) + (F.least(F.greatest(index, F.lit(0)), F.lit(n_edges)) - F.lit(0.5)) * F.lit(step)
