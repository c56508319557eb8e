"""Spectra as arrays: unit conversion, masking, scaling, down-sampling, continuum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "array<struct<label:string,wavelength:array<double>,flux:array<double>,uncertainty:array<double>>>"
LIGHT = 2.99792458e18  # Angstrom a second


def ivar_sigma(ivar: Column) -> Column:
    return F.transform(ivar, lambda x: F.when(x > 0, 1 / F.sqrt(x)))


def to_angstrom(wave: Column, unit: str) -> Column:
    factor = {"angstrom": 1.0, "nm": 10.0, "um": 1e4}
    if unit == "log10":
        return F.transform(wave, lambda x: F.pow(F.lit(10.0), x))
    return F.transform(wave, lambda x: x * factor[unit])


def jansky_flux(flux: Column, wave: Column) -> Column:
    """erg/s/cm2/A of Jy at wavelengths in A."""
    return F.zip_with(flux, wave, lambda f, w: f * 1e-23 * LIGHT / (w * w))


def finite(wave: Column, flux: Column) -> Column:
    """The (w, f) points where both are numbers."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.filter(F.zip_with(wave, flux, lambda w, f: F.struct(w.alias("w"), f.alias("f"))), lambda p: ok(p["w"]) & ok(p["f"]))


def display_scale(flux: Column) -> Column:
    """The upper median of |flux| without zeros and NaN."""
    sizes = F.array_sort(F.transform(F.filter(flux, lambda x: x.isNotNull() & ~F.isnan(x) & (x != 0)), lambda x: F.abs(x)))
    return F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))


def downsample(x: Column, most: int) -> Column:
    """Every k-th element, k the least with at most `most` left."""
    step = F.greatest(F.lit(1), F.ceil(F.size(x) / F.lit(most))).cast("int")
    return F.filter(x, lambda v, i: F.pmod(i, step) == 0)


def bin_size(wave: np.ndarray) -> float:
    """13 times the median positive step of log wavelength, 0 without one."""
    steps = np.diff(np.log10(wave[wave > 0]))
    steps = steps[steps > 0]
    return float(13 * np.median(steps)) if len(steps) else 0.0


def bin_size_of(wave: Column) -> Column:
    """bin_size as a column over an array."""
    logs = F.transform(F.filter(wave, lambda w: w > 0), lambda w: F.log10(w))
    steps = F.array_sort(F.filter(F.zip_with(F.slice(logs, 2, F.greatest(F.size(logs) - 1, F.lit(0))), logs, lambda b, a: b - a), lambda x: x > 0))
    n = F.size(steps)
    middle = (F.get(steps, F.floor((n - 1) / 2).cast("int")) + F.get(steps, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce(13 * middle, F.lit(0.0))


def continuum(wave: np.ndarray, flux: np.ndarray) -> np.ndarray:
    """A smooth upper envelope: the highest fifth in bins of log wavelength, joined by a local linear fit."""
    good = np.isfinite(wave) & np.isfinite(flux) & (wave > 0)
    if good.sum() < 20:
        return np.full(len(wave), np.nan)
    order = np.argsort(wave[good])
    x, y = np.log10(wave[good][order]), flux[good][order]
    size = max(bin_size(10**x), (x[-1] - x[0]) / 60, 1e-12)
    which = np.floor((x - x[0]) / size).astype(int)
    knots = [(x[which == b].mean(), np.quantile(y[which == b], 0.8)) for b in np.unique(which) if (which == b).sum() >= 3]
    kx, ky = np.array(knots).T
    out = np.empty(len(wave))
    for i, at in enumerate(np.log10(np.where(wave > 0, wave, 10 ** x[0]))):
        w = np.exp(-0.5 * ((kx - at) / (6 * size)) ** 2)
        for _ in range(2):
            mx, my = np.average(kx, weights=w), np.average(ky, weights=w)
            var = np.average((kx - mx) ** 2, weights=w)
            slope = np.average((kx - mx) * (ky - my), weights=w) / var if var > 0 else 0.0
            fit = my + slope * (kx - mx)
            w = w * np.where(ky < fit - 2 * np.abs(ky - fit).mean(), 0.3, 1.0)
        out[i] = my + slope * (at - mx)
    return out


def normalise(df: DataFrame, wave: str, flux: str) -> DataFrame:
    """df with flux divided by its continuum, per row, in Arrow batches."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, fs = b.column(names.index(wave)).to_pylist(), b.column(names.index(flux)).to_pylist()
            new = []
            for w, f in zip(ws, fs):
                if not w or not f:
                    new.append(f)
                    continue
                w_, f_ = np.array(w, float), np.array(f, float)
                new.append((f_ / continuum(w_, f_)).tolist())
            columns = [pa.array(new, pa.list_(pa.float64())) if n == flux else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` " + ("array<double>" if f.name == flux else f.dataType.simpleString()) for f in df.schema)
    return df.mapInArrow(run, schema)
