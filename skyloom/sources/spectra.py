"""Spectrum files of the archives as rows of segments.

What an archive's file looks like is one line of LAYOUTS, read by one interpreter; a new archive is a new line.
Every segment is (label, wavelength in Angstrom, flux, uncertainty or null), its points where wavelength and
flux are numbers, thinned to a number that can be drawn.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.operators.spectra import LIGHT, SEGMENT, continuum
from skyloom.sources import fits

FACTORS = {"": 1.0, "angstrom": 1.0, "aa": 1.0, "nm": 10.0, "um": 1e4, "micron": 1e4, "microns": 1e4}
MOST, MOST_ORDER, MOST_BYTES = 4000, 100, 25_000_000


class Unavailable(Exception):
    """The file holds no spectrum that can be shown."""


@dataclass(frozen=True)
class Arm:
    label: str
    ext: str | int  # extension that holds the flux
    flux: str = ""  # column; none for an image
    wave: str = "wcs"  # a column, 'wcs', 'log10 wcs' or '@EXT' for an image of its own
    sigma: str = ""  # a column or '@EXT'
    ivar: bool = False  # sigma holds inverse variances
    step: str = "CDELT1"


@dataclass(frozen=True)
class Layout:
    arms: tuple[Arm, ...]
    scale: float = 1.0  # wavelength to Angstrom, 0: by the column's own unit
    power: str = ""  # 'log10' or 'ln': the wavelength is a logarithm
    row: str = ""  # 'first', 'target' (TARGETID in FIBERMAP) or 'fiber' (in the address): the row of the arrays
    orders: bool = False  # one segment for each row
    jansky: bool = False
    optional: bool = False  # arms may be missing, one must be there
    blaze: str = ""
    only: str = ""  # the instrument's prefix
    votable: bool = False


def _wcs(label: str) -> Layout:
    return Layout((Arm(label, 0),))


def _orders(label: str, power: str) -> Layout:
    return Layout((Arm(label, "SPEC", wave="@WAVE", sigma="@SIG"),), power=power, orders=True)


SDSS = Layout((Arm("SDSS", "COADD", "flux", "loglam", "ivar", True),), power="log10")
# Names of extensions and columns in the archives' files.
LAYOUTS = {
    "lamost": Layout((Arm("LAMOST", "COADD", "FLUX", "WAVELENGTH", "IVAR", True),), row="first"),
    "lamost_mrs": Layout(tuple(Arm(f"MRS {n}", f"COADD_{x}", "FLUX", "WAVELENGTH", "IVAR", True) for n, x in (("blue", "B"), ("red", "R"))), row="first", optional=True),
    "gaia_rvs": Layout((Arm("Gaia RVS", 0, "flux", "wavelength", "flux_error"),), scale=10.0, votable=True),
    "hermes_mercator": Layout((Arm("HERMES", 0, "flux", "spectral"),), votable=True),
    "sdss_v_apogee": Layout((Arm("APOGEE", 1, wave="log10 wcs", sigma="@2"),), row="first"),
    "desi": Layout(tuple(Arm(f"DESI {x}", f"{x}_FLUX", wave=f"@{x}_WAVELENGTH", sigma=f"@{x}_IVAR", ivar=True) for x in "BRZ"), row="target"),
    "sdss_v_optical": SDSS, "sdss_legacy_optical": SDSS,
    "sdss_plate": Layout((Arm("SDSS plate", 0, wave="log10 wcs", sigma="@1", ivar=True, step="CD1_1"),), row="fiber"),
    "mast_jwst": Layout((Arm("JWST", "EXTRACT1D", "FLUX", "WAVELENGTH", "FLUX_ERROR"),), scale=1e4, jansky=True),
    "eso": Layout((Arm("ESO", "SPECTRUM", "FLUX_REDUCED|FLUX", "WAVE", "ERR_REDUCED|ERR"),), scale=0.0),
    "elodie": Layout((Arm("ELODIE", "INTENSITY", sigma="@NOISE"),)), "rave": Layout((Arm("RAVE", "SPECTRUM", sigma="@ERROR"),)), "sophie": Layout((Arm("SOPHIE", "S1D_A"),)),
    "irsa_missions": Layout((Arm("Spitzer/IRS", 1, "FLUX", "WAVELENGTH", "ERROR"),), scale=1e4, only="Spitzer/IRS"),
    "feros_gavo": _wcs("FEROS"), "flashheros_gavo": _wcs("Flash/Heros"), "ondrejov": _wcs("Ondrejov"), "heros_ondrejov": _wcs("HEROS"),
    "carmenes_tac": _orders("CARMENES", "ln"), "carmenes_reiners2018": _orders("CARMENES", ""),
    "cfht_cadc": Layout((Arm("CFHT/SPIRou", "FluxAB", wave="@WaveAB"),), scale=10.0, orders=True, blaze="BlazeAB"),
}


def thin(label: str, wave: np.ndarray, flux: np.ndarray, sigma: np.ndarray | None, most: int) -> dict | None:
    good = np.isfinite(wave) & np.isfinite(flux)
    step = max(1, -(-int(good.sum()) // most))
    pick = np.flatnonzero(good)[::step]
    if not len(pick):
        return None
    if sigma is not None:
        sigma = sigma[pick] if np.isfinite(sigma[pick]).any() else None
    return {"label": label, "wavelength": wave[pick].tolist(), "flux": flux[pick].tolist(), "uncertainty": None if sigma is None else sigma.tolist()}


def _sigma(x: np.ndarray, ivar: bool) -> np.ndarray:
    if not ivar:
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, 1 / np.sqrt(x), np.nan)


class File:
    def __init__(self, raw: bytes, layout: Layout):
        self.columns = fits.votable(raw) if layout.votable else None
        self.units = [] if layout.votable else fits.read(raw)

    def find(self, ext: str | int) -> fits.Unit | None:
        if isinstance(ext, int) or ext.isdigit():
            return self.units[int(ext)] if int(ext) < len(self.units) else None
        return next((u for u in self.units if u.name.upper() == ext.upper()), None)

    def column(self, unit: fits.Unit | None, names: str) -> tuple[np.ndarray, str]:
        for n in names.split("|"):
            if self.columns is not None and n in self.columns:
                return self.columns[n].astype(float), ""
            if unit is not None and n in unit.columns:
                return unit.column(n).astype(float), unit.columns[n].lower()
        raise Unavailable(f"no column {names}")


def parse(archive: str, raw: bytes, obs_id: str = "", url: str = "", instrument: str = "") -> list[dict]:
    """The segments of a file; Unavailable if it isn't what the archive's layout says."""
    layout = LAYOUTS.get("sdss_plate" if archive == "sdss_legacy_optical" and "/spPlate-" in url else archive)
    if layout is None:
        raise Unavailable(f"no reader for {archive}")
    if layout.only and not (instrument or "").startswith(layout.only):
        raise Unavailable(f"only {layout.only}")
    file, row = File(raw, layout), None
    if layout.row == "first":
        row = 0
    elif layout.row == "fiber":
        fiber = re.search(r"fiber=(\d+)$", url)
        if not fiber:
            raise Unavailable("no fiber in the address")
        row = int(fiber[1]) - 1
    elif layout.row == "target":
        hits = np.flatnonzero(file.find("FIBERMAP").column("TARGETID") == int(obs_id))
        if not len(hits):
            raise Unavailable("target not in the file")
        row = int(hits[0])
    segments = []
    for arm in layout.arms:
        unit = file.find(arm.ext)
        if unit is None and not layout.votable:
            if layout.optional:
                continue
            raise Unavailable(f"no extension {arm.ext}")
        own_unit = ""
        if arm.flux:
            flux, _ = file.column(unit, arm.flux)
            wave, own_unit = file.column(unit, arm.wave)
            sigma = _sigma(file.column(unit, arm.sigma)[0], arm.ivar) if arm.sigma else None
        else:
            flux, h = unit.image(), unit.header
            if arm.wave.startswith("@"):
                other = file.find(arm.wave[1:])
                if other is None:
                    raise Unavailable(f"no extension {arm.wave[1:]}")
                wave = other.image()
            else:
                wave = h["CRVAL1"] + np.arange(int(h["NAXIS1"])) * h[arm.step]
                wave = 10.0**wave if arm.wave.startswith("log10") else wave
            second = file.find(arm.sigma[1:]) if arm.sigma else None
            sigma = _sigma(second.image(), arm.ivar) if second is not None else None
        if row is not None:
            if row >= len(flux) and flux.ndim > 1:
                raise Unavailable("row out of range")
            flux, wave, sigma = (x if x is None or x.ndim == 1 and x is not flux else x[row] if x.ndim > 1 else x for x in (flux, wave, sigma))
        if layout.scale == 0:
            if own_unit not in FACTORS:
                raise Unavailable(f"unit {own_unit}")
            wave = wave * FACTORS[own_unit]
        else:
            wave = wave * layout.scale
        wave = 10.0**wave if layout.power == "log10" else np.exp(wave) if layout.power == "ln" else wave
        if layout.blaze and (b := file.find(layout.blaze)) is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                flux = np.where(b.image() != 0, flux / b.image(), np.nan)
        if layout.jansky:
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = 1e-23 * LIGHT / wave**2 * 1e17
            flux, sigma = flux * factor, None if sigma is None else sigma * factor
        if layout.orders:
            parts = [(wave[i], flux[i], None if sigma is None else sigma[i]) for i in range(len(flux)) if np.any(flux[i] != 0)]
            segments += [s for w, f, e in parts if (s := thin(arm.label, w, f, e, MOST_ORDER))]
        elif s := thin(arm.label, wave.reshape(-1), flux.reshape(-1), None if sigma is None else sigma.reshape(-1), MOST):
            segments.append(s)
    if not segments:
        raise Unavailable("no usable data")
    return segments


def header_cards(url: str, hosts: set[str], fetch, size: int, most_units: int = 20) -> list[tuple[str, dict]]:
    """(extension, keywords) of a remote file's units, of which only headers are fetched: fetch(start, stop) gives bytes.
    Addresses that are not http(s) on one of `hosts` are refused before anything is fetched."""
    parts = urllib.parse.urlsplit(url or "")
    if parts.scheme not in ("http", "https") or (parts.hostname or "").lower() not in hosts or parts.username is not None:
        raise Unavailable("address not allowed")
    return [(name, head) for name, head, *_ in fits.Ranges(fetch, size).units[:most_units]]


def parse_ranges(archive: str, fetch, size: int, obs_id: str = "", url: str = "") -> list[dict]:
    """As parse(), of a file of any size that is fetched by ranges, for the layouts that hold many spectra: the headers, the
    table of targets and one row of each array are read, nothing else."""
    layout = LAYOUTS.get("sdss_plate" if archive == "sdss_legacy_optical" and "/spPlate-" in url else archive)
    if layout is None or layout.row not in ("target", "fiber"):
        raise Unavailable(f"{archive} is not read by ranges")
    file = fits.Ranges(fetch, size)
    index = {name.upper(): i for i, (name, *_) in enumerate(file.units)}
    find = lambda ext: ext if isinstance(ext, int) else index[ext.upper()] if not ext.isdigit() else int(ext)
    if layout.row == "target":
        hits = np.flatnonzero(file.whole(find("FIBERMAP")).column("TARGETID") == int(obs_id))
        row = int(hits[0]) if len(hits) else -1
    else:
        fiber = re.search(r"fiber=(\d+)$", url)
        row = int(fiber[1]) - 1 if fiber else -1
    if row < 0:
        raise Unavailable("no such row")
    segments = []
    for arm in layout.arms:
        flux = file.row(find(arm.ext), row)
        h = flux.header
        wave = file.whole(find(arm.wave[1:])).image() if arm.wave.startswith("@") else 10.0 ** (h["CRVAL1"] + np.arange(int(h["NAXIS1"])) * h[arm.step])
        sigma = _sigma(file.row(find(arm.sigma[1:]), row).image().reshape(-1), arm.ivar)
        if s := thin(arm.label, wave * layout.scale, flux.image().reshape(-1), sigma, MOST):
            segments.append(s)
    return segments


def write_spectrum(archive: str, flux: np.ndarray, start: float = 5000.0) -> bytes:
    """A file in the layout of an archive, with flux at start, start + 1, ... Angstrom (10**(3.7 + 0.0001 i) where the layout
    counts in logarithms by header), an uncertainty of 0.5, and spectra of zeros around it where it holds several."""
    layout, n = LAYOUTS[archive], len(flux)
    wave = start + np.arange(n)
    shown = wave / (layout.scale or 10.0)
    shown = np.log10(shown) if layout.power == "log10" else np.log(shown) if layout.power == "ln" else shown
    head = {"CRVAL1": start, "CDELT1": 1.0}
    logs = {"CRVAL1": 3.7, "CDELT1": 1e-4, "CD1_1": 1e-4}
    if layout.votable:
        arm = layout.arms[0]
        return fits.write_votable({arm.wave: shown.tolist(), arm.flux: flux.tolist(), **({arm.sigma: [0.5] * n} if arm.sigma else {})})
    many = layout.row in ("target", "fiber") or layout.orders or archive == "sdss_v_apogee"
    last = layout.row in ("target", "fiber")
    stack = lambda a: np.stack([a * 0, a] if last else [a, a * 0]) if many else a
    first = isinstance(layout.arms[0].ext, int) and layout.arms[0].ext == 0
    units = [] if first else [fits.PRIMARY]
    if layout.row == "target":
        units.append(fits.table_unit({"TARGETID": np.array([1, 77])}, "FIBERMAP"))
    for arm in layout.arms:
        error = np.full(n, 4.0 if arm.ivar else 0.5)
        ext = arm.ext if isinstance(arm.ext, str) else ""
        if arm.flux:
            names = [x.split("|")[-1] for x in (arm.flux, arm.wave, arm.sigma) if x]
            values = [flux, shown, error][: len(names)]
            if layout.row == "first" or archive == "eso":
                values = [v[None] for v in values]
            units.append(fits.table_unit(dict(zip(names, values)), ext, {names[1]: "nm"} if layout.scale == 0 else None))
            continue
        f = flux * 2 if layout.blaze else flux
        units.append(fits.image_unit(stack(f), ext, first and not units, **(logs if arm.wave.startswith("log10") else {} if arm.wave.startswith("@") else head)))
        if arm.wave.startswith("@"):
            units.append(fits.image_unit(np.stack([shown, shown]) if layout.orders else shown, arm.wave[1:]))
        if arm.sigma:
            units.append(fits.image_unit(stack(error), "" if arm.sigma[1:].isdigit() else arm.sigma[1:]))
        if layout.blaze:
            units.append(fits.image_unit(stack(np.full(n, 2.0)), layout.blaze))
    return fits.write(units)


def read_spectra(files: DataFrame, normalised: bool = False, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """archive_obs_id, the columns in keep, segments and error of rows (archive_code, archive_obs_id, archive_url, instrument, content): a
    row that can't be read has an error and no segments, and never stops the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, errors = [], [], []
            for r in b.to_pylist():
                ids.append(r["archive_obs_id"])
                try:
                    if r["content"] is None or len(r["content"]) > MOST_BYTES:
                        raise Unavailable("no file, or one over the limit")
                    segments = parse(r["archive_code"], r["content"], r["archive_obs_id"], r["archive_url"] or "", r["instrument"] or "")
                    if normalised:
                        for s in segments:
                            level = continuum(np.array(s["wavelength"]), np.array(s["flux"]))
                            s["flux"] = (np.array(s["flux"]) / level).tolist()
                            if s["uncertainty"] is not None:
                                s["uncertainty"] = (np.array(s["uncertainty"]) / level).tolist()
                    found.append(segments), errors.append(None)
                except Exception as e:  # noqa: BLE001
                    found.append(None), errors.append(str(e) or type(e).__name__)
            kind = pa.list_(pa.struct([("label", pa.string()), *[(n, pa.list_(pa.float64())) for n in ("wavelength", "flux", "uncertainty")]]))
            more = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *more, pa.array(found, kind), pa.array(errors, pa.string())], names=["archive_obs_id", *keep, "segments", "error"])

    kept = "".join(f"`{k}` {files.schema[k].dataType.simpleString()}, " for k in keep)
    return files.select("archive_code", "archive_obs_id", "archive_url", "instrument", "content", *keep).mapInArrow(run, f"archive_obs_id string, {kept}segments {SEGMENT}, error string")
