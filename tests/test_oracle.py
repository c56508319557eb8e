"""Queries against their SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from skyloom.plans import registry  # noqa: E402
from tools.compare import norm  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
NAMES = [
    "p1_found", "p1_by_pair", "p2_found", "g01_archive_status", "g05_star_name_index", "g08_top_cumulative", "g12_diversity", "g15_most_observed", "g19_triage_queue", "g21_archive_overlap_triple",
    "g28_treemap", "g29_status_pivot", "m01_match_records", "m06_upsert", "m07_pick_best", "m09_add_stars", "m18_reconcile_raw", "m20_import_votes", "j12_radial_join", "j13_star_star", "j15_unmatched_cone",
    "c01_gemini", "c04_mast", "c11_desi", "c24_carmenes_tac", "c33_elodie", "c35_salt_hrs", "c41_gtc", "y04_desi", "y07_mast_jwst", "y16_cfht_cadc", "m06_ids_unique", "m08_register", "m10_discover", "m11_upsert_stars",
    "m17_reconcile_late", "st02_gap_windows", "st04_boundary_ties", "st08_log_stream", "s01_jdbc", "s11_append_votes", "s13_distilled", "s16_access_log", "j21_remote_joins", "q04_batch_rows", "q07_series_gaps", "q12_review_queue",
    "f12_healpix", "f20_packed_rows", "f08_propagated", "f15_aitoff", "f19_numbers_range", "x06_sexagesimal", "x18_flexible_date", "q04_batch_lookup", "w05_forward_fill", "t07_offset_wrap", "c00_feed_batch",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted(repr(tuple(norm(dict(zip(names, r))[c]) for c in sorted(names))) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
