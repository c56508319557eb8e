"""Neighbours and containing regions on the sphere.

Method: a sample of all positions, in proportion to the rows, shapes a quadtree over (ra, dec); its leaves are the
partitions, so dense sky gets small leaves. A position belongs to the one leaf that holds it; a star is also copied to
every leaf its search circle touches, and a region to every leaf its limits touch. Each leaf bulk-loads R-trees,
probes them with its positions, and refines the candidates exactly. A pair is reported only by the leaf that
owns its reference point, the probing position (of two stars the one with the smaller id), so none comes twice.

A leaf that stays too heavy at the greatest depth, because many rows lie at one place, is divided into a grid of
tasks: its probing rows are dealt to the grid's rows and its stars to the grid's columns, so each pair of the two meets
in just one task and both sides of a task are bounded. Regions go to the first column. The sample only shapes the
partitions. Every row is joined, whatever the sample holds. Where a place holds many rows and many stars within the
radius, all their pairs are results, and their number is the product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.rtree import RTree

DEEPEST = 14  # cells of 0.011 degrees of declination and 0.022 of right ascension
PER_LEAF = 50  # sampled positions in a full leaf


def unit(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


def morton(col: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _spread(col) | (_spread(row) << 1)


@dataclass(frozen=True)
class QuadTree:
    """Leaves in Morton order at a depth of at most `deepest`: first code and depth of each, and the grid of tasks
    that share it, so many rows for the probing positions and columns for the stars."""

    deepest: int
    start: np.ndarray
    depth: np.ndarray
    rows: np.ndarray
    columns: np.ndarray

    @property
    def side(self) -> int:
        return 1 << self.deepest

    @classmethod
    def fit(cls, ra: np.ndarray, dec: np.ndarray, star: np.ndarray, cap: float, radius: float) -> QuadTree:
        """Splits the heaviest node until none weighs more than `cap` or can be split. A sampled position weighs 1, one of
        a star 2, as a star is also copied. Cells are no smaller than the circles of `radius` degrees."""
        deepest = int(np.clip(np.floor(np.log2(90 / max(radius, 1e-9))), 1, DEEPEST))
        tree = cls(deepest, *(np.zeros(1, np.int64),) * 4)
        codes = tree.codes(ra, dec)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        stars = np.r_[0, np.cumsum(star[order])]
        spans = {d: 1 << (2 * (deepest - d)) for d in range(deepest + 1)}

        def node(code: int, depth: int) -> tuple:
            lo, hi = np.searchsorted(codes, (code, code + spans[depth]))
            n_stars = int(stars[hi] - stars[lo])
            return (-(int(hi - lo) + n_stars), code, depth, int(hi - lo), n_stars)

        heap, done = [node(0, 0)], []
        while heap:
            weight, code, depth, n, n_stars = heapq.heappop(heap)
            if -weight > cap and depth < deepest:
                for i in range(4):
                    heapq.heappush(heap, node(code + i * spans[depth + 1], depth + 1))
                continue
            if -weight <= cap:
                done.append((code, depth, 1, 1))
            elif n_stars <= cap / 2:
                done.append((code, depth, int(np.ceil(n / (cap - n_stars))), 1))
            else:
                done.append((code, depth, int(np.ceil(2 * n / cap)), int(np.ceil(2 * n_stars / cap))))
        done.sort()
        return cls(deepest, *(np.array(x, np.int64) for x in zip(*done)))

    def cells(self, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.clip(np.floor(ra / 360 * self.side).astype(np.int64), 0, self.side - 1)
        row = np.clip(np.floor((dec + 90) / 180 * self.side).astype(np.int64), 0, self.side - 1)
        return column, row

    def codes(self, ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
        return morton(*self.cells(ra, dec)) if len(ra) else np.zeros(0, np.int64)

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, codes, side="right") - 1

    def circles(self, ra: np.ndarray, dec: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf that the circle of `radius` degrees about each point may touch."""
        r = radius * (1 + 1e-9) + 1e-9
        with np.errstate(invalid="ignore", divide="ignore"):
            dra = np.degrees(np.arcsin(np.sin(np.radians(r)) / np.cos(np.radians(dec))))
        whole = ~(np.abs(dec) + r < 90) | ~np.isfinite(dra)
        lo_c, hi_c = (np.floor((ra + d) / 360 * self.side) for d in (-dra, dra))
        lo_c, hi_c = np.where(whole, 0, lo_c).astype(np.int64), np.where(whole, self.side - 1, hi_c).astype(np.int64)
        lo_r, hi_r = self.cells(ra, np.maximum(dec - r, -90))[1], self.cells(ra, np.minimum(dec + r, 90))[1]
        wide, high = np.minimum(hi_c - lo_c + 1, self.side), hi_r - lo_r + 1
        n = wide * high
        at = np.repeat(np.arange(len(ra)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        leaf = self.leaf(morton((lo_c[at] + k % wide[at]) % self.side, lo_r[at] + k // wide[at]))
        pairs = np.unique(np.stack([at, leaf], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def boxes(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for rows (ra_min, ra_max, dec_min, dec_max) with ra_min <= ra_max."""
        column, row = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        for bit in range(self.deepest):
            column |= ((self.start >> (2 * bit)) & 1) << bit
            row |= ((self.start >> (2 * bit + 1)) & 1) << bit
        size = 1 << (self.deepest - self.depth)
        ra0, dec0 = column * 360 / self.side, row * 180 / self.side - 90
        ra1, dec1 = (column + size) * 360 / self.side, (row + size) * 180 / self.side - 90
        found = [
            np.flatnonzero((ra0 <= b + 1e-9) & (ra1 >= a - 1e-9) & (dec0 <= d + 1e-9) & (dec1 >= c - 1e-9)) for a, b, c, d in limits
        ]
        at = np.repeat(np.arange(len(found)), [len(x) for x in found])
        return at.astype(np.int64), np.concatenate([*found, np.zeros(0, int)]).astype(np.int64)


def region(shape: int, v: np.ndarray) -> dict:
    """A routed region (CIRCLE or BOX and its four numbers) by the names of its limits."""
    if shape == CIRCLE:
        return {"shape": "circle", "center_ra": v[0], "center_dec": v[1], "radius_deg": v[2]}
    return {"shape": "box", "ra_min": v[0], "dec_min": v[1], "ra_max": v[2], "dec_max": v[3]}


def region_limits(r: dict) -> list[tuple[float, float, float, float]]:
    """The ra/dec rectangles that hold a region, none of them through ra 0."""
    if r["shape"] == "circle":
        c, d, rad = r["center_ra"] % 360, r["center_dec"], r["radius_deg"]
        if abs(d) + rad >= 90:
            return [(0.0, 360.0, max(d - rad, -90.0), min(d + rad, 90.0))]
        half = float(np.degrees(np.arcsin(np.sin(np.radians(rad)) / np.cos(np.radians(d))))) + 1e-9
        a, b, lo, hi = c - half, c + half, d - rad - 1e-9, d + rad + 1e-9
    else:
        a, b, lo, hi = r["ra_min"], r["ra_max"], r["dec_min"], r["dec_max"]
        if a > b:
            return [(a, 360.0, lo, hi), (0.0, b, lo, hi)]
    if a < 0:
        return [(a + 360, 360.0, lo, hi), (0.0, b, lo, hi)]
    if b > 360:
        return [(a, 360.0, lo, hi), (0.0, b - 360, lo, hi)]
    return [(a, b, lo, hi)]


def _holds(r: dict, ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    if r["shape"] == "circle":
        centre = unit(np.array([r["center_ra"]]), np.array([r["center_dec"]]))
        chord = ((unit(ra, dec) - centre) ** 2).sum(axis=1)
        return chord <= (2 * np.sin(np.radians(r["radius_deg"]) / 2)) ** 2
    in_dec = (dec >= r["dec_min"]) & (dec <= r["dec_max"])
    if r["ra_min"] > r["ra_max"]:
        return in_dec & ((ra >= r["ra_min"]) | (ra <= r["ra_max"]))
    return in_dec & (((ra >= r["ra_min"]) & (ra <= r["ra_max"])) | ((ra == 0) & (r["ra_max"] == 360)))


ROUTED = "leaf int, part int, kind int, id bigint, ra double, dec double, x double, y double"
PAIR = "kind string, id_a bigint, id_b bigint"
STAR_PROBE, ROW_PROBE, STAR, CIRCLE, BOX = range(5)


def _batch(leaf, part, kind, key, ra, dec, x=None, y=None) -> pa.RecordBatch:
    none = pa.nulls(len(leaf), pa.float64())
    small = [pa.array(c.astype(np.int32)) for c in (leaf, part, kind)]
    return pa.RecordBatch.from_arrays(
        [*small, pa.array(key), pa.array(ra), pa.array(dec), none if x is None else pa.array(x), none if y is None else pa.array(y)],
        names=["leaf", "part", "kind", "id", "ra", "dec", "x", "y"],
    )


def _deal(key: np.ndarray, salt: int, n: np.ndarray) -> np.ndarray:
    return ((key ^ salt) * np.int64(-7046029254386353131) >> 33) % n


def _copies(tree: QuadTree, leaf: np.ndarray, first: np.ndarray, times: np.ndarray, by_row: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, part) of `times` copies of each, along the row `first` of its leaf's grid or along the column."""
    at = np.repeat(np.arange(len(leaf)), times)
    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    columns = tree.columns[leaf[at]]
    return at, first[at] * columns + k if by_row else k * columns + first[at]


def _router(sent, radius: float):
    """Positions (kind, id, ra, dec) to the leaves they probe in, and stars also as STAR to all leaves near them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = QuadTree(*sent.value)
        for batch in batches:
            kind, key, ra, dec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            leaf = tree.leaf(tree.codes(ra, dec))
            at, part = _copies(tree, leaf, _deal(key, 0, tree.rows[leaf]), tree.columns[leaf], True)
            yield _batch(leaf[at], part, kind[at], key[at], ra[at], dec[at])
            own = np.flatnonzero(kind == STAR_PROBE)
            star, to = tree.circles(ra[own], dec[own], radius)
            star = own[star]
            at, part = _copies(tree, to, _deal(key[star], 0x5DEECE66D, tree.columns[to]), tree.rows[to], False)
            star = star[at]
            yield _batch(to[at], part, np.full(len(at), STAR), key[star], ra[star], dec[star])

    return route


def _region_router(sent):
    """Regions (shape, id and four numbers) to all leaves that their limits touch."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = QuadTree(*sent.value)
        for batch in batches:
            kind, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            v = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, 6)], axis=1)
            limits = [(i, x) for i in range(len(key)) for x in region_limits(region(kind[i], v[i]))]
            box, leaf = tree.boxes(np.array([x for _, x in limits]).reshape(-1, 4))
            pairs = np.unique(np.stack([np.array([i for i, _ in limits], np.int64)[box], leaf], axis=1), axis=0)
            at, part = _copies(tree, pairs[:, 1], np.zeros(len(pairs), np.int64), tree.rows[pairs[:, 1]], False)
            of, leaf = pairs[at, 0], pairs[at, 1]
            yield _batch(leaf, part, kind[of], key[of], *(v[of, i] for i in range(4)))

    return route


def _leaf_join(radius: float):
    """All pairs of one leaf (or of one task of a divided leaf)."""
    chord = 2 * np.sin(np.radians(radius) / 2)

    def join(table: pa.Table) -> pa.Table:
        kind, key, ra, dec = (table.column(c).to_numpy() for c in ("kind", "id", "ra", "dec"))
        kinds, a, b = [], [], []

        def add(name: str, x: np.ndarray, y: np.ndarray) -> None:
            kinds.append(np.full(len(x), name, object)), a.append(x), b.append(y)

        star, probe = kind == STAR, kind < STAR
        u, pk = unit(ra, dec), kind[probe]
        su, pu, sid, pid = u[star], u[probe], key[star], key[probe]
        for q, s in RTree(su, su).probe(pu - chord * (1 + 1e-9) - 1e-15, pu + chord * (1 + 1e-9) + 1e-15):
            near = ((pu[q] - su[s]) ** 2).sum(axis=1) <= chord**2
            q, s = q[near], s[near]
            rows = pk[q] == ROW_PROBE
            add("row_star", pid[q[rows]], sid[s[rows]])
            q, s = q[~rows], s[~rows]
            first = pid[q] < sid[s]  # the smaller id's own place is the pair's reference point
            add("star_star", pid[q[first]], sid[s[first]])
        here, rows = np.flatnonzero(kind >= CIRCLE), kind == ROW_PROBE
        if len(here) and rows.any():
            rid, rra, rdec = key[rows], ra[rows], dec[rows]
            more = np.stack([ra, dec, *(table.column(c).to_numpy() for c in "xy")], axis=1)
            regions = [region(kind[i], more[i]) for i in here]
            limits = [(i, x) for i, r in enumerate(regions) for x in region_limits(r)]
            lo = np.array([(x[0], x[2]) for _, x in limits]) - 1e-9
            hi = np.array([(x[1], x[3]) for _, x in limits]) + 1e-9
            of, at = np.array([i for i, _ in limits]), np.stack([rra, rdec], axis=1)
            if (rra == 0).any():  # 0 is also the edge of what ends at 360
                lo[:, 0] = np.where(hi[:, 0] >= 360, np.minimum(lo[:, 0], 0), lo[:, 0])
            for q, box in RTree(lo, hi).probe(at, at):
                pairs = np.unique(np.stack([q, of[box]], axis=1), axis=0)
                for i in np.unique(pairs[:, 1]):
                    mine = pairs[pairs[:, 1] == i, 0]
                    mine = mine[_holds(regions[i], rra[mine], rdec[mine])]
                    add("row_field", rid[mine], np.full(len(mine), key[here[i]], np.int64))
        if not kinds:
            return pa.table({"kind": pa.array([], pa.string()), "id_a": pa.array([], pa.int64()), "id_b": pa.array([], pa.int64())})
        return pa.table({"kind": pa.array(np.concatenate(kinds), pa.string()), "id_a": pa.array(np.concatenate(a), pa.int64()), "id_b": pa.array(np.concatenate(b), pa.int64())})

    return join


def _positions(df: DataFrame, kind: int, key: str, ra: str, dec: str) -> DataFrame:
    ra_, dec_ = F.col(ra).cast("double"), F.col(dec).cast("double")
    good = ra_.isNotNull() & dec_.isNotNull() & ~F.isnan(ra_) & ~F.isnan(dec_) & dec_.between(-90, 90) & (F.abs(ra_) < float("inf")) & F.col(key).isNotNull()
    wrapped = F.pmod(ra_, F.lit(360.0))
    return df.filter(good).select(
        F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.when(wrapped >= 360, 0.0).otherwise(wrapped).alias("ra"), dec_.alias("dec")
    )


def _regions(df: DataFrame) -> DataFrame:
    """(shape, id, four numbers) of the regions that have all their numbers."""
    circle, box = F.col("shape") == "circle", F.col("shape") == "box"
    pairs = {"ra": ("center_ra", "ra_min"), "dec": ("center_dec", "dec_min"), "x": ("radius_deg", "ra_max"), "y": (None, "dec_max")}
    numbers = [F.when(circle, F.col(a) if a else F.lit(0.0)).otherwise(F.col(b)).cast("double").alias(n) for n, (a, b) in pairs.items()]
    listed = df.filter(circle | box).select(F.when(circle, CIRCLE).otherwise(BOX).alias("kind"), F.col("field_id").cast("bigint").alias("id"), *numbers)
    for c in ("ra", "dec", "x", "y"):
        listed = listed.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return listed.filter("id IS NOT NULL")


def sky_neighbours(
    stars: DataFrame, rows: DataFrame, regions: DataFrame | None = None, radius_arcsec: float = 10.0,
    star_cols: tuple[str, str, str] = ("star_id", "ra", "dec"), row_cols: tuple[str, str, str] = ("id", "raw_ra", "raw_dec"),
    leaf_rows: int = 20_000, most_sample: int = 4_000_000,
) -> DataFrame:
    """(kind, id_a, id_b): 'star_star', stars within the radius of each other, smaller id first; 'row_star',
    rows and stars within it; 'row_field', rows and the regions (schema of sky_fields) that hold them.

    Positions with a null, NaN, infinite coordinate, a declination outside -90..90 or a null id take no part;
    right ascension counts modulo 360. Edges and the radius itself are included. Ids are keys: a pair of rows comes
    once, and rows that repeat an id pair each, as in a join. Empty tables give no rows; other columns are not
    read. Regions with a null limit or id hold nothing. The driver gets PER_LEAF sampled positions for each
    leaf_rows rows, at most most_sample in all; beyond that (1.6 billion rows) leaves grow with the rows."""
    spark = stars.sparkSession
    probes = _positions(stars, STAR_PROBE, *star_cols).unionByName(_positions(rows, ROW_PROBE, *row_cols))
    total = stars.count() + rows.count()
    share = min(1.0, PER_LEAF / leaf_rows, most_sample / max(total, 1))
    if total * share < 100_000:  # few rows: what the driver may hold anyway shapes better leaves
        share = min(1.0, 100_000 / max(total, 1))
    picked = probes if share == 1 else probes.filter(F.pmod(F.xxhash64("id", "kind"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.select("ra", "dec", (F.col("kind") == STAR_PROBE).alias("star")).toPandas()
    cap = max(leaf_rows * share, PER_LEAF if share < 1 else 1)
    tree = QuadTree.fit(sample.ra.to_numpy(), sample.dec.to_numpy(), sample.star.to_numpy().astype(np.int64), cap, radius_arcsec / 3600)
    sent = spark.sparkContext.broadcast((tree.deepest, tree.start, tree.depth, tree.rows, tree.columns))
    routed = probes.mapInArrow(_router(sent, radius_arcsec / 3600), ROUTED)
    if regions is not None:
        routed = routed.unionByName(_regions(regions).mapInArrow(_region_router(sent), ROUTED))
    return routed.groupBy("leaf", "part").applyInArrow(_leaf_join(radius_arcsec / 3600), PAIR)
