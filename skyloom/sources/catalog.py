"""The archives, how each is reached, paged and identified."""

from __future__ import annotations

from typing import NamedTuple


PAGINGS = ["watermark", "watermark with ids", "id", "window", "adaptive window", "per instrument", "once", "row", "page", "list"]


class Archive(NamedTuple):
    access: str
    paging: str  # one of PAGINGS
    identity: str  # G catalogue id, N name, P position
    mark: str  # the column that orders the log
    page: int = 20_000


# One line an archive.
ARCHIVES = {
    "gemini": Archive("tap", "window", "NP", "t_min"),
    "gemini_ghost": Archive("rest_json", "adaptive window", "N", "t_min", 2000),
    "gemini_igrins": Archive("rest_json", "adaptive window", "N", "t_min", 2000),
    "mast": Archive("tap", "watermark", "NP", "t_min"),
    "mast_jwst": Archive("tap", "window", "NP", "t_min"),
    "noirlab": Archive("rest_json", "per instrument", "NP", "dateobs_center"),
    "eso": Archive("tap", "watermark", "NP", "t_min"),
    "eso_raw": Archive("tap", "watermark", "NP", "mjd_obs"),
    "gaia_rvs": Archive("tap", "id", "G", "source_id", 50_000),
    "galah": Archive("tap", "watermark", "G", "mjd"),
    "desi": Archive("bulk_file", "row", "G", "row"),
    "sdss_v_apogee": Archive("cas_sql", "id", "G", "apogee_id"),
    "sdss_v_optical": Archive("bulk_file", "watermark", "G", "mjd"),
    "sdss_legacy_optical": Archive("cas_sql", "window", "P", "mjd"),
    "lamost": Archive("sql_api", "id", "G", "obsid"),
    "lamost_mrs": Archive("sql_api", "id", "G", "obsid"),
    "koa": Archive("tap", "per instrument", "NP", "mjd"),
    "cfht_cadc": Archive("tap", "watermark", "NP", "t_min"),
    "dao": Archive("tap", "watermark", "NP", "t_min"),
    "weave": Archive("stub", "once", "", ""),
    "4most": Archive("stub", "once", "", ""),
    "rave": Archive("tap", "once", "G", "obsid"),
    "carmenes": Archive("bulk_file", "once", "G", "name"),
    "carmenes_tac": Archive("bulk_file", "once", "G", "name"),
    "carmenes_caha": Archive("html_form", "page", "NP", "page"),
    "carmenes_reiners2018": Archive("bulk_file", "once", "G", "name"),
    "lbt": Archive("tap", "per instrument", "GNP", "date_obs"),
    "lick": Archive("directory_listing", "window", "N", "night"),
    "feros_gavo": Archive("tap", "once", "N", "accref"),
    "flashheros_gavo": Archive("tap", "once", "N", "accref"),
    "asiago": Archive("tap", "id", "NP", "id"),
    "harpsn_tng": Archive("tap", "id", "NP", "id"),
    "elodie": Archive("html_form", "once", "NP", "obs"),
    "sophie": Archive("html_form", "list", "NP", "prefix"),
    "salt_hrs": Archive("graphql", "watermark", "N", "millis"),
    "ing": Archive("html_form", "adaptive window", "NP", "date", 2000),
    "naoj": Archive("tap", "watermark", "NP", "t_mid"),
    "neid": Archive("tap", "watermark", "NP", "obsjd"),
    "not_fies": Archive("html_form", "adaptive window", "NP", "date", 1000),
    "oirsa": Archive("tap", "watermark", "NP", "t_min", 50_000),
    "gtc": Archive("html_form", "adaptive window", "NP", "date", 3000),
    "hermes_mercator": Archive("tap", "id", "NP", "unique_seqno"),
    "bess": Archive("html_form", "list", "NP", "star"),
    "hpol": Archive("html_form", "list", "NP", "row", 200),
    "chandra": Archive("tap", "watermark", "NP", "start_date"),
    "irtf_spex": Archive("tap", "watermark with ids", "N", "time_bounds_lower"),
    "irtf_ishell": Archive("tap", "watermark with ids", "N", "time_bounds_lower"),
    "irtf_legacy": Archive("html_form", "adaptive window", "NP", "date", 5000),
    "lco_floyds": Archive("rest_json", "watermark with ids", "NP", "start"),
    "lco_nres": Archive("rest_json", "watermark with ids", "NP", "start"),
    "ondrejov": Archive("tap", "watermark with ids", "NP", "ssa_dateobs"),
    "heros_ondrejov": Archive("tap", "watermark with ids", "NP", "ssa_dateobs"),
    "polarbase": Archive("rest_json", "adaptive window", "NP", "date", 10_000),
    "subaru_moircs": Archive("tap", "id", "NP", "id"),
    "iacob": Archive("ssa", "once", "NP", "id"),
    "ritter_prest": Archive("html_form", "once", "NP", "link"),
    "svo_cab": Archive("ssa", "once", "NP", "id"),
    "irsa_missions": Archive("ssa", "list", "NP", "cell"),
    "xmm": Archive("tap", "watermark", "NP", "start_date"),
}

RAW_OBSERVATION = (
    "archive_code string, archive_obs_id string, archive_url string, instrument string, obs_date date, program_id string, gaia_source_id bigint, "
    "ra double, dec double, raw_target_name string, reduction_status string"
)
