"""A small reader of FITS images and binary tables and of VOTables, enough for one-dimensional spectra."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np

BLOCK, CARD = 2880, 80
KINDS = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


@dataclass
class Unit:
    header: dict
    raw: bytes
    name: str = ""
    columns: dict[str, str] = field(default_factory=dict)  # name to unit

    def image(self) -> np.ndarray:
        h = self.header
        shape = [int(h[f"NAXIS{i}"]) for i in range(int(h["NAXIS"]), 0, -1)]
        a = np.frombuffer(self.raw, PIXELS[int(h["BITPIX"])], int(np.prod(shape))).reshape(shape)
        return a.astype(float) * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))

    def table(self) -> np.ndarray:
        h, fields = self.header, []
        for i in range(1, int(h["TFIELDS"]) + 1):
            n, kind = re.match(r"(\d*)([A-Z])", str(h[f"TFORM{i}"]).strip()).groups()
            n = int(n or 1)
            name = str(h.get(f"TTYPE{i}", f"col{i}")).strip()
            fields.append((name, f"S{n}") if kind == "A" else (name, KINDS[kind], (n,)) if n != 1 else (name, KINDS[kind]))
        return np.frombuffer(self.raw, np.dtype(fields), int(h["NAXIS2"]))

    def column(self, name: str) -> np.ndarray:
        t = self.table()
        found = next((c for c in t.dtype.names if c.lower() == name.lower()), None)
        if found is None:
            raise KeyError(name)
        return t[found]


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1 : text.rindex("'")].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def cards(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """A header's keywords and the place behind it."""
    header: dict = {}
    while at + CARD <= len(raw):
        card = raw[at : at + CARD].decode("ascii", "replace")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            return header, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            header[key] = _value(card[10:])
    raise ValueError("header without END")


def read(raw: bytes) -> list[Unit]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    units, at = [], 0
    while at + BLOCK <= len(raw):
        header, at = cards(raw, at)
        axes = [int(header[f"NAXIS{i}"]) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
        size = abs(int(header.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        size = (size + int(header.get("PCOUNT", 0))) * int(header.get("GCOUNT", 1)) if axes else 0
        unit = Unit(header, raw[at : at + size], str(header.get("EXTNAME", "")).strip())
        if "TFIELDS" in header:
            unit.columns = {str(header.get(f"TTYPE{i}", "")).strip(): str(header.get(f"TUNIT{i}", "")).strip() for i in range(1, int(header["TFIELDS"]) + 1)}
        units.append(unit)
        at += -(-size // BLOCK) * BLOCK
    return units


def write(units: list[tuple[dict, bytes]]) -> bytes:
    """FITS bytes of (keywords, data) pairs, for tests."""
    out = b""
    for header, data in units:
        lines = [f"{k:<8}= {('T' if v is True else repr(v) if isinstance(v, str) else v)!s:>20}".ljust(CARD) for k, v in header.items()] + ["END".ljust(CARD)]
        text = "".join(lines).encode()
        out += text.ljust(-(-len(text) // BLOCK) * BLOCK) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")
    return out


def image_unit(a: np.ndarray, name: str = "", first: bool = False, **more) -> tuple[dict, bytes]:
    """For write(): an image of doubles."""
    a = np.asarray(a, ">f8")
    axes = {f"NAXIS{i + 1}": n for i, n in enumerate(a.shape[::-1])}
    head = {"SIMPLE": True} if first else {"XTENSION": "IMAGE"}
    return {**head, "BITPIX": -64, "NAXIS": a.ndim, **axes, **({"EXTNAME": name} if name else {}), **more}, a.tobytes()


def table_unit(columns: dict[str, np.ndarray], name: str = "", units: dict[str, str] | None = None) -> tuple[dict, bytes]:
    """For write(): a binary table of numbers, a row for each first index of the columns."""
    arrays = {k: np.asarray(v) for k, v in columns.items()}
    fields = [(k, ">i8" if v.dtype.kind == "i" else ">f8", v.shape[1:]) for k, v in arrays.items()]
    data = np.zeros(len(next(iter(arrays.values()))), fields)
    for k, v in arrays.items():
        data[k] = v
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": data.dtype.itemsize, "NAXIS2": len(data), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(fields)}
    for i, (k, t, shape) in enumerate(fields, 1):
        head |= {f"TTYPE{i}": k, f"TFORM{i}": f"{int(np.prod(shape)) if shape else 1}{'K' if t == '>i8' else 'D'}", **({f"TUNIT{i}": units[k]} if units and k in units else {})}
    return head | ({"EXTNAME": name} if name else {}), data.tobytes()


PRIMARY = ({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"")


def write_votable(columns: dict[str, list]) -> bytes:
    shown = lambda x: "" if x is None or x != x else str(x)
    clean = lambda x: shown(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    fields = "".join(f'<FIELD name="{k}" datatype="char" arraysize="*"/>' for k in columns)
    rows = "".join("<TR>" + "".join(f"<TD>{clean(x)}</TD>" for x in r) + "</TR>" for r in zip(*columns.values()))
    return f'<VOTABLE version="1.3"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>{rows}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>'.encode()


class Ranges:
    """The units of a FITS file that is fetched by ranges: fetch(start, stop) gives bytes. Headers are read in blocks, data
    only as asked for."""

    def __init__(self, fetch, size: int):
        self.fetch, self.units, at = fetch, [], 0
        while at + BLOCK <= size:
            raw = b""
            while True:
                raw += fetch(at + len(raw), min(at + len(raw) + 4 * BLOCK, size))
                try:
                    header, length = cards(raw)
                    break
                except ValueError:
                    if at + len(raw) >= size:
                        raise
            axes = [int(header[f"NAXIS{i}"]) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
            n = (abs(int(header["BITPIX"])) // 8 * int(np.prod(axes)) + int(header.get("PCOUNT", 0))) if axes else 0
            self.units.append((str(header.get("EXTNAME", "")).strip(), header, at + length, n))
            at += length + -(-n // BLOCK) * BLOCK

    def whole(self, i: int) -> Unit:
        name, header, start, n = self.units[i]
        unit = Unit(header, self.fetch(start, start + n), name)
        if "TFIELDS" in header:
            unit.columns = {str(header.get(f"TTYPE{k}", "")).strip(): str(header.get(f"TUNIT{k}", "")).strip() for k in range(1, int(header["TFIELDS"]) + 1)}
        return unit

    def row(self, i: int, row: int) -> Unit:
        """The unit with only one row of its image."""
        name, header, start, _ = self.units[i]
        width = abs(int(header["BITPIX"])) // 8 * int(header["NAXIS1"])
        if not 0 <= row < int(header.get("NAXIS2", 1)):
            raise IndexError(row)
        return Unit({**header, "NAXIS2": 1}, self.fetch(start + row * width, start + (row + 1) * width), name)


def votable(raw: bytes) -> dict[str, np.ndarray]:
    """The columns of a VOTable's first TABLEDATA table; blanks are NaN, text stays as it is."""
    root = ET.fromstring(raw)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    table = root.find(".//TABLE")
    names = [f.get("name") for f in table.findall("FIELD")]
    rows = [[td.text or "" for td in tr.findall("TD")] for tr in table.iter("TR")]
    out = {}
    for i, n in enumerate(names):
        column = [r[i] for r in rows]
        try:
            out[n] = np.array([float(x) if x.strip() else np.nan for x in column])
        except ValueError:
            out[n] = np.array(column, object)
    return out
