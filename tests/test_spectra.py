import gzip

import numpy as np

from skyloom.operators.spectra import bin_size, continuum
from skyloom.sources import fits
from skyloom.sources.spectra import LAYOUTS, read_spectra

PRIMARY = ({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"")
WAVE = np.linspace(5000, 5100, 50)
FLUX = 1 + 0.1 * np.sin(WAVE)


def image(a, name="", first=False, **more):
    a = np.asarray(a, ">f8")
    axes = {f"NAXIS{i + 1}": n for i, n in enumerate(a.shape[::-1])}
    return ({("SIMPLE" if first else "XTENSION"): True if first else "IMAGE", "BITPIX": -64, "NAXIS": a.ndim, **axes, **({"EXTNAME": name} if name else {}), **more}, a.tobytes())


def table(columns, name="", units=None, rows=None):
    arrays = {k: np.asarray(v) for k, v in columns.items()}
    n = rows if rows is not None else len(next(iter(arrays.values())))
    fields = [(k, ">i8" if v.dtype.kind == "i" else ">f8", v.shape[1:]) for k, v in arrays.items()]
    data = np.zeros(n, fields)
    for k, v in arrays.items():
        data[k] = v
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": data.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(fields)}
    for i, (k, t, shape) in enumerate(fields, 1):
        head |= {f"TTYPE{i}": k, f"TFORM{i}": f"{int(np.prod(shape)) if shape else 1}{'K' if t == '>i8' else 'D'}"}
        if units and k in units:
            head[f"TUNIT{i}"] = units[k]
    return (head | ({"EXTNAME": name} if name else {}), data.tobytes())


def vo(**columns):
    fields = "".join(f'<FIELD name="{k}" datatype="double"/>' for k in columns)
    rows = "".join("<TR>" + "".join(f"<TD>{x}</TD>" for x in r) + "</TR>" for r in zip(*columns.values()))
    return f'<VOTABLE xmlns="http://x"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>{rows}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>'.encode()


IVAR = np.full(50, 4.0)
LINE = {"CRVAL1": 5000.0, "CDELT1": float(WAVE[1] - WAVE[0])}
LOG = {"CRVAL1": float(np.log10(5000)), "CDELT1": 1e-4, "CD1_1": 1e-4}
TWO = np.stack([WAVE, WAVE])
ONE_ROW = {"WAVELENGTH": WAVE[None], "FLUX": FLUX[None], "IVAR": IVAR[None]}
FILES = {
    "lamost": gzip.compress(fits.write([PRIMARY, table(ONE_ROW, "COADD")])), "lamost_mrs": fits.write([PRIMARY, table(ONE_ROW, "COADD_R")]),
    "gaia_rvs": vo(wavelength=WAVE / 10, flux=FLUX, flux_error=IVAR), "hermes_mercator": vo(spectral=WAVE, flux=FLUX),
    "sdss_v_apogee": fits.write([PRIMARY, image(np.stack([FLUX, FLUX]), **LOG), image(np.stack([IVAR, IVAR]))]),
    "desi": fits.write([PRIMARY, table({"TARGETID": np.array([3, 77])}, "FIBERMAP"), *[x for a in "BRZ" for x in (image(WAVE, f"{a}_WAVELENGTH"), image(np.stack([FLUX * 0, FLUX]), f"{a}_FLUX"), image(np.stack([IVAR, IVAR]), f"{a}_IVAR"))]]),
    "sdss_v_optical": fits.write([PRIMARY, table({"loglam": np.log10(WAVE), "flux": FLUX, "ivar": IVAR}, "COADD")]), "sdss_legacy_optical": fits.write([image(np.stack([FLUX * 0, FLUX]), first=True, **LOG), image(np.stack([IVAR, IVAR]))]),
    "mast_jwst": fits.write([PRIMARY, table({"WAVELENGTH": WAVE / 1e4, "FLUX": FLUX, "FLUX_ERROR": IVAR}, "EXTRACT1D")]),
    "eso": fits.write([PRIMARY, table({"WAVE": WAVE[None] / 10, "FLUX": FLUX[None], "ERR": IVAR[None]}, "SPECTRUM", {"WAVE": "nm"})]),
    "elodie": fits.write([PRIMARY, image(FLUX, "INTENSITY", **LINE), image(IVAR, "NOISE")]), "rave": fits.write([PRIMARY, image(FLUX, "SPECTRUM", **LINE)]), "sophie": fits.write([PRIMARY, image(FLUX, "S1D_A", **LINE)]),
    "irsa_missions": fits.write([PRIMARY, table({"WAVELENGTH": WAVE / 1e4, "FLUX": FLUX, "ERROR": IVAR})]),
    **{a: fits.write([image(FLUX, first=True, **LINE)]) for a in ("feros_gavo", "flashheros_gavo", "ondrejov", "heros_ondrejov")},
    "carmenes_tac": fits.write([PRIMARY, image(np.stack([FLUX, FLUX * 0]), "SPEC"), image(TWO, "SIG"), image(np.log(TWO), "WAVE")]), "carmenes_reiners2018": fits.write([PRIMARY, image(np.stack([FLUX, FLUX]), "SPEC"), image(TWO, "SIG"), image(TWO, "WAVE")]),
    "cfht_cadc": fits.write([PRIMARY, image(np.stack([2 * FLUX, FLUX]), "FluxAB"), image(TWO / 10, "WaveAB"), image(np.stack([FLUX * 0 + 2, FLUX * 0 + 1]), "BlazeAB")]),
}


def test_every_layout(spark):
    url = {"sdss_legacy_optical": "http://x/spPlate-0266-51630.fits?fiber=2"}
    rows = [(a, "77", url.get(a, "u"), "Spitzer/IRS" if a == "irsa_missions" else None, f, "x") for a, f in FILES.items()]
    rows += [("lamost", "bad", None, None, b"junk", "x"), ("nobody", "none", None, None, b"", "x"), ("eso", "null", None, None, None, "x"), ("irsa_missions", "other", None, "WISE", FILES["irsa_missions"], "x"), ("desi", "5", None, None, FILES["desi"], "x")]
    df = spark.createDataFrame([(a, f"{a}:{o}" if a != "desi" else o, u, i, c, e) for a, o, u, i, c, e in rows], "archive_code string, archive_obs_id string, archive_url string, instrument string, content binary, segments string")
    got = {r["archive_obs_id"]: r for r in read_spectra(df).collect()}
    assert set(FILES) | {"sdss_plate"} == set(LAYOUTS)
    for a in FILES:
        r = got["77" if a == "desi" else f"{a}:77"]
        assert r["error"] is None, (a, r["error"])
        assert len(r["segments"]) == {"desi": 3, "carmenes_reiners2018": 2, "cfht_cadc": 2}.get(a, 1)
        s = r["segments"][0]
        want = FLUX * 1e-23 * 2.99792458e18 / WAVE**2 * 1e17 if a == "mast_jwst" else FLUX
        assert np.allclose(s["flux"], want) and (np.allclose(s["wavelength"], WAVE) or a in ("sdss_v_apogee", "sdss_legacy_optical")), a
        if LAYOUTS["sdss_plate" if "legacy" in a else a].arms[0].ivar:
            assert np.allclose(s["uncertainty"], 0.5)
    assert abs(got["sdss_legacy_optical:77"]["segments"][0]["wavelength"][0] - 5000) < 1e-6
    assert all(got[k]["error"] and got[k]["segments"] is None for k in ("lamost:bad", "nobody:none", "eso:null", "irsa_missions:other", "5"))


def test_continuum_ignores_a_line_and_order():
    rng = np.random.default_rng(1)
    w = np.linspace(5000, 5500, 1500)
    f = 1 - 0.35 * np.exp(-0.5 * ((w - 5250) / 5) ** 2) + rng.normal(0, 0.004, len(w))
    c = continuum(w, f)
    assert np.abs(c - 1).max() < 0.05 and abs(np.median((f / c)[np.abs(w - 5250) > 30]) - 1) < 0.02
    mix = rng.permutation(len(w))
    assert np.allclose(continuum(w[mix], f[mix]), c[mix])
    assert abs(bin_size(10 ** (3.7 + 1e-4 * np.arange(100))) - 13e-4) < 1e-9 and np.isnan(continuum(w[:5], f[:5])).all()


def test_normalised_divides_both(spark):
    df = spark.createDataFrame([("elodie", "a", None, None, FILES["elodie"])], "archive_code string, archive_obs_id string, archive_url string, instrument string, content binary")
    a, b = read_spectra(df).first()["segments"][0], read_spectra(df, True).first()["segments"][0]
    assert abs(np.mean(b["flux"]) - 1) < 0.15 and np.allclose(np.array(a["flux"]) / a["uncertainty"], np.array(b["flux"]) / b["uncertainty"])


def test_written_files_are_read_and_ranges_fetch_one_row():
    from skyloom.sources.spectra import parse, parse_ranges, write_spectrum

    flux = 1 + np.arange(40) / 10
    for layout in LAYOUTS:
        archive, url = ("sdss_legacy_optical", "http://x/spPlate-1.fits?fiber=2") if layout == "sdss_plate" else (layout, "u")
        raw = write_spectrum(layout, flux)
        whole = parse(archive, raw, "77", url, "Spitzer/IRS")
        assert {len(g["wavelength"]) for g in whole} == {40}, layout
        if LAYOUTS[layout].row in ("target", "fiber"):
            fetched = []
            big = raw + b"\0" * 0
            fetch = lambda a, b: fetched.append(b - a) or big[a:b]
            assert parse_ranges(archive, fetch, len(raw), "77", url) == whole


def test_header_cards_are_read_by_ranges_from_known_hosts_only():
    import pytest

    from skyloom.sources.spectra import Unavailable, header_cards

    raw, read = FILES["desi"], []
    fetch = lambda a, b: read.append(b - a) or raw[a:b]
    cards = header_cards("https://data.example/x.fits", {"data.example"}, fetch, len(raw))
    assert [n for n, _ in cards][:3] == ["", "FIBERMAP", "B_WAVELENGTH"] and cards[1][1]["TFIELDS"] == 1
    for bad in ("http://other.example/x", "file:///etc/passwd", "https://data.example@other.example/", "https://u@data.example/", "", None):
        with pytest.raises(Unavailable):
            header_cards(bad, {"data.example"}, lambda a, b: pytest.fail("fetched"), 1)
