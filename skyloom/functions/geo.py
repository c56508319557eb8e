"""Sky geometry as Columns: angles in degrees, separations in the unit of their name."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAS = math.pi / 180 / 3_600_000
ARCSEC = 180 * 3600 / math.pi


def clamp(x: Column, low: float, high: float) -> Column:
    """x within limits; null stays null, which greatest and least would pass over."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def usable(ra: Column, dec: Column) -> Column:
    """True where both coordinates are numbers and the declination exists; never null."""
    return F.coalesce(ra.isNotNull() & dec.isNotNull() & ~F.isnan(ra) & ~F.isnan(dec) & dec.between(-90, 90), F.lit(False))


def julian_year(day: Column) -> Column:
    """The Julian epoch at 0 h of a date."""
    return 2000.0 + (F.datediff(day, F.lit("2000-01-01").cast("date")) - 0.5) / 365.25


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]


def moved_vector(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column) -> list[Column]:
    """Unit vector after straight motion; pm in mas a year, pmra with cos dec; null motion or time is none."""
    a, d = F.radians(ra), F.radians(dec)
    t = F.coalesce(years, F.lit(0.0)) * MAS
    east, north = F.coalesce(pmra, F.lit(0.0)) * t, F.coalesce(pmdec, F.lit(0.0)) * t
    x = F.cos(d) * F.cos(a) - F.sin(a) * east - F.sin(d) * F.cos(a) * north
    y = F.cos(d) * F.sin(a) + F.cos(a) * east - F.sin(d) * F.sin(a) * north
    z = F.sin(d) + F.cos(d) * north
    length = F.sqrt(1 + east * east + north * north)
    return [x / length, y / length, z / length]


def vector_separation(u: list[Column], v: list[Column]) -> Column:
    """Arcseconds between unit vectors, by the chord, exact for small angles too."""
    chord = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(u, v)), F.lit(0.0)))
    return 2 * F.asin(clamp(chord / 2, 0.0, 1.0)) * ARCSEC


def motion(ra: Column, dec: Column, pmra: Column, pmdec: Column) -> list[Column]:
    """A star's unit vector, its motion in a year and the square of that, as columns that moved_separation reads."""
    a, d = F.radians(ra), F.radians(dec)
    east, north = F.coalesce(pmra, F.lit(0.0)) * MAS, F.coalesce(pmdec, F.lit(0.0)) * MAS
    by = [-F.sin(a) * east - F.sin(d) * F.cos(a) * north, F.cos(a) * east - F.sin(d) * F.sin(a) * north, F.cos(d) * north]
    return [*unit_vector(ra, dec), *by, east * east + north * north]


def moved_separation(u: list[Column], star: list[Column], years: Column) -> Column:
    """vector_separation of u and the moved_vector of motion()'s columns; nothing in it is named so often that what tests each
    pair of a join outgrows the size that Java still compiles."""
    t = F.coalesce(years, F.lit(0.0))
    length = F.sqrt(1 + star[6] * t * t)
    x, y, z = (a - (b + by * t) / length for a, b, by in zip(u, star[:3], star[3:6]))
    return 2 * F.asin(F.least(F.hypot(F.hypot(x, y), z) / 2, F.lit(1.0))) * ARCSEC


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return vector_separation(unit_vector(ra1, dec1), unit_vector(ra2, dec2))


def cosine_separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees by the law of cosines, clamped; can't resolve the smallest angles."""
    c = F.sin(F.radians(dec1)) * F.sin(F.radians(dec2)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(clamp(c, -1.0, 1.0)))


def aitoff(ra: Column, dec: Column) -> Column:
    """(x, y) of the Aitoff projection seen from inside: right ascension grows to the left."""
    lam = F.radians(F.when(ra > 180, 360 - ra).otherwise(-ra))
    d = F.radians(dec)
    alpha = F.acos(clamp(F.cos(d) * F.cos(lam / 2), -1.0, 1.0))
    sinc = F.when(alpha == 0, 1.0).otherwise(F.sin(alpha) / alpha)
    return F.struct((2 * F.cos(d) * F.sin(lam / 2) / sinc).alias("x"), (F.sin(d) / sinc).alias("y"))


# The J2000 direction of the galactic pole and the longitude of the celestial pole, degrees.
GALACTIC_POLE = (192.85948, 27.12825, 122.93192)


def galactic_to_icrs(lon: Column, lat: Column) -> Column:
    ra0, dec0, l0 = (math.radians(x) for x in GALACTIC_POLE)
    b, dl = F.radians(lat), l0 - F.radians(lon)
    sin_d = F.sin(b) * math.sin(dec0) + F.cos(b) * math.cos(dec0) * F.cos(dl)
    y = F.cos(b) * F.sin(dl)
    x = F.sin(b) * math.cos(dec0) - F.cos(b) * math.sin(dec0) * F.cos(dl)
    return F.struct(F.pmod(F.degrees(F.atan2(y, x) + ra0), F.lit(360.0)).alias("ra"), F.degrees(F.asin(clamp(sin_d, -1.0, 1.0))).alias("dec"))


def _spread_bits(x: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def healpix(ra: Column, dec: Column, level: int) -> Column:
    """Nested HEALPix pixel (Gorski et al. 2005) of a position; nside is 2**level."""
    n = 1 << level
    z, tt = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90
    whole = lambda x: F.floor(x).cast("bigint")
    jp, jm = whole(n * (0.5 + tt) - n * z * 0.75), whole(n * (0.5 + tt) + n * z * 0.75)
    fp, fm = F.shiftright(jp, level), F.shiftright(jm, level)
    belt_face = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, fp).otherwise(fm + 8)
    belt_x, belt_y = jm.bitwiseAND(F.lit(n - 1)), (n - 1) - jp.bitwiseAND(F.lit(n - 1))
    quarter = F.least(whole(tt), F.lit(3))
    tp, size = tt - quarter, n * F.sqrt(3 * (1 - F.abs(z)))
    cp, cm = F.least(whole(tp * size), F.lit(n - 1)), F.least(whole((1 - tp) * size), F.lit(n - 1))
    north = z >= 0
    belt = F.abs(z) <= 2 / 3
    face = F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8)
    x = F.when(belt, belt_x).when(north, (n - 1) - cm).otherwise(cp)
    y = F.when(belt, belt_y).when(north, (n - 1) - cp).otherwise(cm)
    # bound once: the bits are named so often that the expression would outgrow generated code
    bound = F.array(F.struct(face.alias("face"), x.alias("x"), y.alias("y")))
    pixel = lambda v: F.shiftleft(v["face"], 2 * level) + _spread_bits(v["x"]).bitwiseOR(F.shiftleft(_spread_bits(v["y"]), 1))
    return F.get(F.transform(bound, pixel), F.lit(0))


def source_id_range(pixel: Column, level: int) -> Column:
    """The catalogue ids, which lead with a level-12 pixel, that lie in a pixel of a level."""
    shift = 35 + 2 * (12 - level)
    return F.struct(F.shiftleft(pixel, shift).alias("first"), (F.shiftleft(pixel + 1, shift) - 1).alias("last"))


# Fixed values of the HEALPix geometry (Gorski et al. 2005; the neighbour tables as published with healpix_cxx and
# astropy-healpix): steps to the 8 neighbours, faces beyond each edge and the turns there.
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
FACES = [
    [8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9], [5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8], [-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1],
    [4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], [1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4],
    [-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1], [3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7], [2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3],
]
TURNS = [[0, 0, 3], [0, 0, 6], [0, 0, 0], [0, 0, 5], [0, 0, 0], [5, 0, 0], [0, 0, 0], [6, 0, 0], [3, 0, 0]]


def rings(pixels: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, pixel) for every pixel and its up to 8 neighbours, ascending for each."""
    n, bits = 1 << level, np.arange(level)
    face, rest = pixels >> (2 * level), pixels & (n * n - 1)
    x, y = ((((rest[:, None] >> (2 * bits + k)) & 1) << bits).sum(axis=1) for k in (0, 1))
    dx, dy = np.array(STEPS).T
    a, b = x[:, None] + dx, y[:, None] + dy
    side = 4 + (a >= n) - (a < 0).astype(int) + 3 * (b >= n) - 3 * (b < 0)
    a, b = a % n, b % n
    f, turn = np.array(FACES)[side, face[:, None]], np.array(TURNS)[side, face[:, None] >> 2]
    a, b = np.where(turn & 1, n - 1 - a, a), np.where(turn & 2, n - 1 - b, b)
    a, b = np.where(turn & 4, b, a), np.where(turn & 4, a, b)
    inside = sum((((a >> i) & 1) << (2 * i)) | (((b >> i) & 1) << (2 * i + 1)) for i in range(level))
    near = np.where(f >= 0, (f.astype(np.int64) << (2 * level)) + inside, -1)
    pairs = np.stack([np.repeat(np.arange(len(pixels)), 9), np.concatenate([pixels[:, None], near], axis=1).ravel()], axis=1)
    pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
    return pairs[:, 0], pairs[:, 1]


def ring_width(level: int) -> float:
    """Arcseconds that a pixel and its ring reach at least beyond any point of the pixel: of the root of a pixel's area the
    narrowest pixels have 0.69 from edge to edge."""
    return 0.6 * math.sqrt(math.pi / 3) / (1 << level) * ARCSEC


def ring_level(reach_arcsec: float) -> int:
    """The deepest level whose rings reach so far, at most 18 and at least 0."""
    return next((n for n in range(18, 0, -1) if ring_width(n) >= reach_arcsec), 0)


def with_rings(df: DataFrame, pixel: str, out: str, level: int) -> DataFrame:
    """df with a row for each pixel of the ring about `pixel`, which must not be null, in column `out`."""
    names = df.columns
    at = names.index(pixel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, near = rings(b.column(at).to_numpy(zero_copy_only=False), level)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(of)).columns, pa.array(near)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` bigint"
    return df.mapInArrow(run, schema)
