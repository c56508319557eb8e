"""Raw log rows of the archives as records of one shape.

An archive is a few SQL expressions over the columns of its log, one for each field that it knows; what it
doesn't know is null. Where a log lists several products of an observation, `best` orders them and the first
stays. Addresses that a log doesn't hold are made from a template of the caller, with the id in place of {id}.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.sources.catalog import ARCHIVES, RAW_OBSERVATION


class Field(str):
    """A field's SQL over the log's columns, with what recording the field takes: the column and the SQL that gives it
    from a record, and the SQL of what then comes back (of the DuckDB kind)."""

    raw: dict[str, str]
    back: str

    def __new__(cls, sql: str, raw: dict[str, str], back: str) -> Field:
        self = super().__new__(cls, sql)
        self.raw, self.back = raw, back
        return self


class Map(NamedTuple):
    fields: dict[str, str]
    keep: str = "true"  # which rows of the log are observations
    best: str = ""  # the order in which one product of several stays
    unpivot: str = ""  # columns that are rows
    raw: dict[str, str] = {}  # columns of the log from a record, where the fields don't say
    back: dict[str, str] = {}  # what comes back, likewise
    kept: str = "true"  # the records that come back
    products: tuple[str, ...] = ("",)  # the log's products of an observation, as p in raw


def bare(x: str) -> bool:
    return x.isidentifier()


def num(x: str) -> str:
    return Field(f"CASE WHEN NOT isnan(try_cast({x} AS DOUBLE)) THEN try_cast({x} AS DOUBLE) END", {x: "CAST({f} AS STRING)"} if bare(x) else {}, "{f}")


def text(x: str) -> str:
    return Field(f"nullif(trim(CAST({x} AS STRING)), '')", {x: "{f}"} if bare(x) else {}, "nullif(trim({f}), '')")


def mjd(x: str) -> str:
    return Field(f"date_add(DATE'1858-11-17', CAST(floor({num(x)}) AS INT))", {x: "CAST(datediff({f}, DATE'1858-11-17') + 0.25D AS STRING)"} if bare(x) else {}, "{f}")


def iso(x: str) -> str:
    return Field(f"try_to_date(substring(CAST({x} AS STRING), 1, 10), 'yyyy-MM-dd')", {x: "date_format({f}, 'yyyy-MM-dd') || 'T01:02:03'"} if bare(x) else {}, "{f}")


def level(x: str) -> str:
    back = "CASE WHEN {f} IN ('raw', 'reduced') THEN {f} END"
    return Field(f"CASE WHEN try_cast({x} AS INT) <= 1 THEN 'raw' WHEN try_cast({x} AS INT) > 1 THEN 'reduced' END", {x: "CASE {f} WHEN 'raw' THEN '1' WHEN 'reduced' THEN '2' END"}, back)


def gaia(x: str) -> str:
    return Field(f"try_cast({x} AS BIGINT)", {x: "CAST({f} AS STRING)"}, "{f}")


def const(x: str) -> str:
    return Field(f"'{x}'", {}, f"'{x}'")


def place(ra: str, dec: str, radians: bool = False) -> dict[str, str]:
    if not radians:
        return {"ra": num(ra), "dec": num(dec)}
    return {f: Field(f"degrees({num(x)})", {x: "CAST(radians({f}) AS STRING)"}, "{f}") for f, x in (("ra", ra), ("dec", dec))}


ON_SKY = "ra >= 0 AND ra < 360 AND dec BETWEEN -90 AND 90"


def sexagesimal(ra: str, dec: str) -> dict[str, str]:
    """Places typed as h m s and d m s; what is no such text is null, and a zero place is a placeholder."""

    def angle(x: str, top: int, times: int) -> str:
        p = [f"try_cast(get(split(trim({x}), '[:\\\\s]+'), {i}) AS DOUBLE)" for i in range(3)]
        size = f"(abs({p[0]}) + {p[1]}/60 + {p[2]}/3600)"
        return f"CASE WHEN {size} <= {top} AND {p[1]} < 60 AND {p[2]} < 60 THEN {times}*{size}*CASE WHEN trim({x}) LIKE '-%' THEN -1 ELSE 1 END END"

    a, d = angle(ra, 24, 15), angle(dec, 90, 1)
    some = f"NOT (coalesce({a}, 1) = 0 AND coalesce({d}, 1) = 0)"
    hundredths = lambda x: f"floor({x}*360000)"
    parts = lambda x: [f"floor({hundredths(x)}/360000)", f"floor(({hundredths(x)}%360000)/6000)", f"({hundredths(x)}%6000)/100"]
    typed = lambda x, sign: f"CASE WHEN {ON_SKY} THEN format_string('%s%02d:%02d:%05.2f', {sign}, CAST({parts(x)[0]} AS INT), CAST({parts(x)[1]} AS INT), CAST({parts(x)[2]} AS DOUBLE)) END"
    whole = lambda x: "({} + {}/60 + {}/3600)".format(*parts(x))
    back_ra, back_dec = f"15*{whole('(ra/15)')}", f"CASE WHEN dec < 0 THEN -1 ELSE 1 END*{whole('abs(dec)')}"
    there = f"{ON_SKY} AND NOT ({back_ra} = 0 AND {back_dec} = 0)"
    return {
        "ra": Field(f"CASE WHEN {some} THEN {a} END", {ra: typed("(ra/15)", "''")}, f"CASE WHEN {there} THEN {back_ra} END"),
        "dec": Field(f"CASE WHEN {some} THEN {d} END", {dec: typed("abs(dec)", "CASE WHEN dec < 0 THEN '-' ELSE '+' END")}, f"CASE WHEN {there} THEN {back_dec} END"),
    }


def obscore(key: str, url: str | None = None, **more: str) -> Map:
    fields = {"archive_obs_id": text(key), "instrument": text("instrument_name"), "obs_date": mjd("t_min"), **place("s_ra", "s_dec"), "raw_target_name": text("target_name"), "reduction_status": level("calib_level"), **more}
    return Map(fields | ({"archive_url": url} if url else {}))


def by_id(key: str, instrument: str, id_: str, date: str | None = None, keep: str | None = None, raw: dict[str, str] = {}, kept: str = "gaia_source_id IS NOT NULL") -> Map:  # noqa: B006
    fields = {"archive_obs_id": text(key), "instrument": const(instrument), "gaia_source_id": gaia(id_), "reduction_status": const("reduced")}
    return Map(fields | ({"obs_date": date} if date else {}), keep or f"try_cast({id_} AS BIGINT) IS NOT NULL", raw=raw, back={"obs_date": "obs_date"} if date else {}, kept=kept)


def ssa(key: str, name: str, date: str, instrument: str, **more: str) -> Map:
    return Map({"archive_obs_id": text(key), "archive_url": text(key), "instrument": instrument, "obs_date": date, "raw_target_name": text(name), **more}, raw={key: "archive_obs_id"}, back={"archive_url": "archive_obs_id"})


LOCATION = "regexp_extract_all(CAST(ssa_location AS STRING), '(-?[0-9]+\\\\.?[0-9]*)', 1)"
TYPED = {"ssa_location": "CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN '(' || CAST(ra AS DECIMAL(20, 12)) || ', ' || CAST(dec AS DECIMAL(20, 12)) || ')' END"}
BOTH = "CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN {f} END"
PAIR = {f: Field(f"try_cast(get({LOCATION}, {i}) AS DOUBLE)", TYPED, BOTH) for i, f in enumerate(("ra", "dec"))}
# rows of the Gemini, IRTF, Las Cumbres and CARMENES archives
GOA = Map({"archive_obs_id": text("name"), "instrument": text("instrument"), "obs_date": iso("ut_datetime"), "program_id": text("program_id"), "raw_target_name": text("object"), "reduction_status": const("reduced")})
IRTF = Map(
    {
        "archive_obs_id": text("planeid"), "archive_url": text("uri"), "instrument": text("instrument_name"), "obs_date": mjd("time_bounds_lower"), "program_id": text("proposal_id"),
        "raw_target_name": text("regexp_replace(target_name, '_[0-9]+$', '')"), "reduction_status": level("calibrationlevel"),
    },
    raw={"target_name": "raw_target_name || '_12'"}, back={"raw_target_name": "nullif(trim(raw_target_name), '')"},
)
LCO = Map(
    {
        "archive_obs_id": text("blkuid"), "instrument": text("instrument_id"), "obs_date": iso("observation_day"), "program_id": text("proposal_id"), **place("area_ra", "area_dec"),
        "raw_target_name": text("target_name"), "reduction_status": "CASE WHEN try_cast(reduction_level AS INT) > 0 THEN 'reduced' ELSE 'raw' END",
    },
    best="reduction_level DESC, id", raw={"reduction_level": "p", "id": "'7'"}, back={"reduction_status": "'reduced'"}, products=("0", "91"),
)
CARMENES = Map(
    {
        "archive_obs_id": "concat_ws('_', karmn, arm)", "archive_url": text("link"), "instrument": "concat('CARMENES ', arm)", "gaia_source_id": gaia("gaia_source_id"),
        "raw_target_name": text("name"), "reduction_status": const("reduced"),
    },
    raw={"karmn": "archive_obs_id", "arm": "'VIS'"}, back={"archive_obs_id": "archive_obs_id || '_VIS'", "instrument": "'CARMENES VIS'"},
)
ARMS = CARMENES._replace(
    keep="link IS NOT NULL", unpivot="stack(2, 'VIS', link_vis, 'NIR', link_nir) AS (arm, link)", kept="archive_url IS NOT NULL AND (p = 'VIS' OR program_id IS NOT NULL)",
    raw={"karmn": "archive_obs_id", "link": "", "link_vis": "archive_url", "link_nir": "CASE WHEN program_id IS NOT NULL THEN archive_url END"},
    back={"archive_obs_id": "archive_obs_id || '_' || p", "instrument": "'CARMENES ' || p"},
)
HTML = {"archive_url": text("url"), "obs_date": iso("date"), "program_id": text("program"), "raw_target_name": text("object")}
NAMED_OR = "coalesce(nullif(trim(raw_target_name), ''), '{}')"
OBJECT = "CASE WHEN lower(trim(object)) <> 'none' THEN nullif(trim(object), '') END"
# The columns of the archives' logs.
MAPS = {
    "gemini": obscore("obs_publisher_did"),
    "cfht_cadc": obscore("obs_publisher_did"),
    "dao": obscore("obs_publisher_did"),
    "oirsa": obscore("obs_publisher_did", text("access_url")),
    "eso": obscore("dp_id", program_id=text("proposal_id")),
    "gemini_ghost": GOA,
    "gemini_igrins": GOA,
    "mast": obscore("obs_id", text("access_url"))._replace(
        best="CASE WHEN access_url LIKE '%\\_vo.fits' THEN 0 ELSE 1 END, access_url", raw={"access_url": "archive_obs_id || p"}, back={"archive_url": "archive_obs_id || '_vo.fits'"}, products=("_a.fits", "_vo.fits")
    ),
    "mast_jwst": obscore("obs_id", text("access_url"))._replace(
        best="CASE WHEN access_url LIKE '%\\_x1d.fits' THEN 0 WHEN access_url LIKE '%\\_x1dints.fits' THEN 1 ELSE 2 END, access_url",
        raw={"access_url": "archive_obs_id || p"}, back={"archive_url": "archive_obs_id || '_x1d.fits'"}, products=("_a.fits", "_x1dints.fits", "_x1d.fits"),
    ),
    "naoj": Map(
        {"archive_obs_id": text("raw_id"), "archive_url": text("access_url"), "instrument": const("HDS"), "obs_date": iso("date_obs"), **place("s_ra", "s_dec"), "raw_target_name": text("substring_index(target_name, ' [', 1)")},
        best="access_format, access_url", raw={"target_name": "raw_target_name || ' [spec]'", "access_format": "p", "access_url": "archive_obs_id || p"},
        back={"archive_url": "archive_obs_id || 'a'", "raw_target_name": "nullif(trim(split_part(raw_target_name, ' [', 1)), '')"}, products=("b", "a"),
    ),
    "eso_raw": Map(
        {
            "archive_obs_id": text("dp_id"), "instrument": text("substring_index(instrument, '/', 1)"), "obs_date": mjd("mjd_obs"), "program_id": text("prog_id"),
            "ra": f"CASE WHEN {num('ra')} BETWEEN 0 AND 360 THEN {num('ra')} END", "dec": f"CASE WHEN {num('dec')} BETWEEN -90 AND 90 THEN {num('dec')} END",
            "raw_target_name": text("target"), "reduction_status": const("raw"),
        },
        raw={"instrument": "instrument || '/X'", "ra": "CAST(ra AS STRING)", "dec": "CAST(dec AS STRING)"},
        back={"instrument": "nullif(trim(split_part(instrument, '/', 1)), '')", "ra": "CASE WHEN ra BETWEEN 0 AND 360 THEN ra END", "dec": "CASE WHEN dec BETWEEN -90 AND 90 THEN dec END"},
    ),
    "galah": by_id("sobject_id", "GALAH (HERMES)", "gaiadr3_source_id", mjd("mjd")),
    "gaia_rvs": Map({"archive_obs_id": text("source_id"), "instrument": const("Gaia RVS"), "gaia_source_id": gaia("source_id")}, raw={"source_id": "CAST(gaia_source_id AS STRING)"}, back={"archive_obs_id": "gaia_source_id::VARCHAR"}, kept="gaia_source_id IS NOT NULL"),
    "desi": by_id("targetid", "DESI", "source_id", keep="try_cast(source_id AS BIGINT) <> 999999", raw={"source_id": "CAST(coalesce(gaia_source_id, 999999) AS STRING)"}),
    "sdss_v_apogee": by_id("apogee_id", "APOGEE", "gaiaedr3_source_id"),
    "rave": by_id("obsid", "RAVE", "gaiae3", mjd("obsdate_jd - 2400000.5"), raw={"obsdate_jd": "CAST(datediff(obs_date, DATE'1858-11-17') + 2400000.75D AS STRING)"}),
    "sdss_v_optical": by_id("specobjid", "SDSS-V/BOSS", "gaia_id", mjd("mjd"), "class = 'STAR' AND try_cast(gaia_id AS BIGINT) > 0", {"class": "CASE WHEN instrument IS NULL THEN 'QSO' ELSE 'STAR' END"}, "gaia_source_id > 0 AND instrument IS NOT NULL"),
    "lamost": by_id("obsid", "LAMOST", "gaia_source_id", mjd("mjd")),
    "lamost_mrs": by_id("obsid", "LAMOST-MRS", "gaia_source_id", mjd("mjd")),
    "sdss_legacy_optical": Map({"archive_obs_id": text("specobjid"), "instrument": const("SDSS/BOSS"), "obs_date": mjd("mjd"), "program_id": text("run2d"), **place("ra", "dec"), "reduction_status": const("reduced")}),
    "koa": Map(
        {"archive_obs_id": text("koaid"), "instrument": text("instrument"), "obs_date": mjd("mjd"), **place("ra", "dec"), "raw_target_name": text("object"), "reduction_status": const("raw")},
        keep=f"{num('mjd')} < 100000", kept="obs_date IS NOT NULL",
    ),
    "noirlab": Map({"archive_obs_id": text("md5sum"), "archive_url": text("url"), "instrument": text("instrument"), "obs_date": iso("dateobs_center"), "program_id": text("proposal"), **place("ra_center", "dec_center"), "raw_target_name": text("object"), "reduction_status": const("raw")}),
    "lbt": Map(
        {
            "archive_obs_id": f"coalesce({text('file_name')}, concat(lower(instrument), '-', date_obs))", "instrument": text("instrument"), "obs_date": iso("date_obs"), "program_id": text("propid"),
            "gaia_source_id": "try_cast(nullif(regexp_extract(object, '^Gaia DR3 ([0-9]+)$', 1), '') AS BIGINT)", **sexagesimal("ra", "dec"), "raw_target_name": OBJECT,
        },
        raw={"file_name": "archive_obs_id", "object": "coalesce(raw_target_name, 'None')"},
        back={"archive_obs_id": "archive_obs_id", "gaia_source_id": "try_cast(nullif(regexp_extract(raw_target_name, '^Gaia DR3 ([0-9]+)$', 1), '') AS BIGINT)", "raw_target_name": "CASE WHEN lower(trim(raw_target_name)) <> 'none' THEN nullif(trim(raw_target_name), '') END"},
    ),
    "neid": Map(
        {"archive_obs_id": text("expid"), "instrument": "concat('NEID ', obsmode)", "obs_date": iso("obsdate"), "program_id": text("program"), **place("tcsrad", "tcsdecd"), "raw_target_name": text("object"), "reduction_status": const("reduced")},
        raw={"obsmode": "instrument"}, back={"instrument": "'NEID ' || instrument"},
    ),
    "chandra": Map(
        {"archive_obs_id": text("obsid"), "instrument": "format_string('%s (%s)', grating, detector)", "obs_date": iso("start_date"), **place("ra", "dec"), "raw_target_name": text("target_name")},
        raw={"grating": "coalesce(instrument, 'NONE')", "detector": "'ACIS'"}, back={"instrument": "coalesce(instrument, 'NONE') || ' (ACIS)'"},
    ),
    "xmm": Map(
        {"archive_obs_id": "concat_ws('_', observation_id, instrument, exposure_id)", "instrument": text("instrument"), "obs_date": iso("start_date"), **place("ra", "dec"), "raw_target_name": text("target")},
        raw={"observation_id": "archive_obs_id", "exposure_id": "'S1'"}, back={"archive_obs_id": "archive_obs_id || coalesce('_' || instrument, '') || '_S1'"},
    ),
    "asiago": Map({"archive_obs_id": text("id"), "instrument": text("instrument"), "obs_date": iso("date_obs"), "program_id": text("program"), **place("ra_rad", "dec_rad", True), "raw_target_name": text("object")}),
    "harpsn_tng": Map(
        {"archive_obs_id": text("id"), "instrument": const("HARPS-N"), "obs_date": iso("date_obs"), "program_id": text("program"), **place("ra_rad", "dec_rad", True), "raw_target_name": text("object")},
        keep="file_name RLIKE '^HARPN\\\\.[0-9T:.-]+\\\\.fits(\\\\.gz)?$'", raw={"file_name": "CASE WHEN instrument IS NULL THEN 'HARPN_bias.fits' ELSE 'HARPN.2020-01-01T00:00:00.1.fits.gz' END"}, kept="instrument IS NOT NULL",
    ),
    "subaru_moircs": Map({"archive_obs_id": text("data_id"), "archive_url": text("access_ref"), "instrument": const("MOIRCS"), "obs_date": iso("date"), **place("ref_val1", "ref_val2"), "raw_target_name": text("object")}),
    "hermes_mercator": Map({"archive_obs_id": text("unique_seqno"), "archive_url": text("accref"), "instrument": const("HERMES"), "obs_date": mjd("ssa_dateobs"), "raw_target_name": text("ssa_targname"), **PAIR}),
    "feros_gavo": ssa("accref", "ssa_targname", mjd("dateobs"), text("instrument")),
    "flashheros_gavo": ssa("accref", "ssa_targname", mjd("dateobs"), const("Flash/Heros")),
    "ondrejov": ssa("accref", "ssa_targname", mjd("ssa_dateobs"), const("CCD700"), **PAIR),
    "heros_ondrejov": ssa("accref", "ssa_targname", mjd("ssa_dateobs"), const("HEROS"), **PAIR),
    "iacob": Map({"archive_obs_id": text("filename"), "archive_url": text("acref"), "instrument": text("instrument"), "obs_date": iso("time"), **place("ra", "dec"), "raw_target_name": text("target")}),
    "svo_cab": Map(
        {"archive_obs_id": "concat(path, ':', associd)", "archive_url": text("specurl"), "instrument": text("instrument"), "obs_date": iso("date"), **place("ra", "dec"), "raw_target_name": "replace(name, '_', ' ')"},
        raw={"path": "'p'", "associd": "archive_obs_id", "name": "raw_target_name"}, back={"archive_obs_id": "'p:' || archive_obs_id", "raw_target_name": "replace(nullif(raw_target_name, ''), '_', ' ')"},
    ),
    "irsa_missions": Map(
        {"archive_obs_id": text("creator_did"), "archive_url": text("access_url"), "instrument": text("instrument"), "obs_date": iso("date"), **place("ra", "dec"), "raw_target_name": text("regexp_replace(target, '^(IRS|ISO)[ _:]+', '')")},
        raw={"target": "'IRS ' || raw_target_name"}, back={"raw_target_name": "nullif(trim(regexp_replace('IRS ' || raw_target_name, '^(IRS|ISO)[ _:]+', '')), '')"},
    ),
    "irtf_spex": IRTF,
    "irtf_ishell": IRTF,
    "lco_floyds": LCO,
    "lco_nres": LCO,
    "polarbase": Map(
        {
            "archive_obs_id": text("id_observation"), "instrument": text("instrument"), "obs_date": iso("date"), "program_id": text("run_id"), **place("alpha", "delta"),
            "raw_target_name": "regexp_replace(coalesce(nullif(trim(simbad_name), ''), trim(object_name)), '\\\\s+', ' ')", "reduction_status": const("reduced"),
        },
        best="date", raw={"simbad_name": "raw_target_name", "object_name": "'obj'"}, back={"raw_target_name": f"regexp_replace({NAMED_OR.format('obj')}, '\\s+', ' ', 'g')"},
    ),
    "salt_hrs": Map(
        {
            "archive_obs_id": text("artifact_id"), "instrument": const("HRS"), "obs_date": "to_date(timestamp_millis(try_cast(start_millis AS BIGINT)))",
            "raw_target_name": text("element_at(map_from_entries(transform(metadata, x -> struct(x.key, x.value))), 'target.name')"),
        },
        raw={"start_millis": "CAST(unix_millis(CAST(obs_date AS TIMESTAMP)) + 5000 AS STRING)", "metadata": "to_json(array(struct('site' AS key, 'S' AS value), struct('target.name' AS key, raw_target_name AS value)))"},
        back={"obs_date": "obs_date", "raw_target_name": "nullif(trim(raw_target_name), '')"},
    ),
    "carmenes": CARMENES,
    "carmenes_tac": ARMS,
    "carmenes_reiners2018": ARMS,
    "carmenes_caha": Map({"archive_obs_id": text("caha_id"), "instrument": text("instrument"), "obs_date": iso("obs_date"), **place("ra", "dec"), "raw_target_name": text("object")}),
    "lick": Map({**HTML, "archive_obs_id": "concat_ws('/', night, file)", "instrument": text("instrument")}, raw={"night": "'n1'", "file": "archive_obs_id"}, back={"archive_obs_id": "'n1/' || archive_obs_id"}),
    "gtc": Map({**HTML, "archive_obs_id": text("prodid"), "instrument": text("instrument"), **sexagesimal("ra", "dec")}),
    "ing": Map(
        {**HTML, "archive_obs_id": text("recno"), "instrument": text("instrument"), **sexagesimal("ra", "dec")},
        keep="obstype = 'TARGET'", best="date", raw={"obstype": "CASE WHEN instrument IS NULL THEN 'ARC' ELSE 'TARGET' END"}, kept="instrument IS NOT NULL",
    ),
    "not_fies": Map(
        {**HTML, "archive_obs_id": text("id"), "instrument": const("FIES"), **sexagesimal("ra", "dec"), "raw_target_name": f"coalesce({text('object')}, {text('tcstarget')})"},
        raw={"object": "raw_target_name", "tcstarget": "'T'"}, back={"raw_target_name": NAMED_OR.format("T")},
    ),
    "irtf_legacy": Map({**HTML, "archive_obs_id": text("file"), "instrument": text("instrument"), **sexagesimal("ra", "dec")}),
    "hpol": Map({"archive_obs_id": text("data_id"), "archive_url": text("url"), "instrument": const("HPOL"), "obs_date": iso("obs_time"), **sexagesimal("ra", "dec"), "raw_target_name": text("target_name")}),
    "bess": Map({**HTML, "archive_obs_id": text("id"), "instrument": text("instrument"), **place("ra", "dec")}),
    "ritter_prest": Map({**HTML, "archive_obs_id": text("file"), "instrument": const("Ritter"), **sexagesimal("ra", "dec")}),
    "elodie": Map(
        {"archive_obs_id": "concat(dataset, '/', imanum)", "instrument": const("ELODIE"), "obs_date": "try_to_date(dataset, 'yyyyMMdd')", **place("ra", "dec"), "raw_target_name": text("objname")},
        keep="imatype LIKE 'OBJ%'", raw={"dataset": "date_format(obs_date, 'yyyyMMdd')", "imanum": "archive_obs_id", "imatype": "CASE WHEN instrument IS NULL THEN 'FLAT' ELSE 'OBJO' END"},
        back={"obs_date": "obs_date", "archive_obs_id": "strftime(obs_date, '%Y%m%d') || '/' || archive_obs_id"}, kept="instrument IS NOT NULL AND obs_date IS NOT NULL",
    ),
    "sophie": Map({"archive_obs_id": text("seq"), "instrument": const("SOPHIE"), "obs_date": iso("date"), **place("ra", "dec"), "raw_target_name": text("objname")}),
}


def to_records(raw: DataFrame, archive: str, template: str | None = None) -> DataFrame:
    """The records of a raw log, in the shape of RAW_OBSERVATION; rows without an id are no observations."""
    if ARCHIVES[archive].access == "stub":
        raise NotImplementedError(f"{archive} has released nothing")
    m = MAPS[archive]
    schema = T.StructType.fromDDL(RAW_OBSERVATION) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(RAW_OBSERVATION)
    kept = (raw.selectExpr("*", m.unpivot) if m.unpivot else raw).filter(m.keep)
    key = F.expr(m.fields["archive_obs_id"])
    if m.best:
        order = Window.partitionBy(key).orderBy(*[F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x) for x in m.best.split(", ")])
        kept = kept.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    out = []
    for f in schema:
        if f.name == "archive_code":
            x = F.lit(archive)
        elif f.name in m.fields:
            x = F.expr(m.fields[f.name])
        elif f.name == "archive_url" and template:
            x = F.concat(F.lit(template.partition("{id}")[0]), F.url_encode(key), F.lit(template.partition("{id}")[2]))
        else:
            x = F.lit(None)
        out.append(x.cast(f.dataType).alias(f.name))
    return kept.select(*out).filter("archive_obs_id IS NOT NULL")


def raw_columns(archive: str) -> dict[str, str]:
    """The columns of an archive's log, each with the SQL that makes it from a record (and p, a product)."""
    m, out = MAPS[archive], {}
    for name, field in m.fields.items():
        for column, sql in getattr(field, "raw", {}).items():
            out.setdefault(column, sql.replace("{f}", name))
    return {c: x for c, x in {**out, **m.raw}.items() if x}


def record_log(records: DataFrame, archive: str) -> DataFrame:
    """Records (the columns of RAW_OBSERVATION) as the archive's log has them, all columns text."""
    m = MAPS[archive]
    each = records.withColumn("p", F.explode(F.array(*map(F.lit, m.products))))
    return each.select(*[F.expr(x).cast("string").alias(c) for c, x in raw_columns(archive).items()])


def comes_back(archive: str, field: str) -> str:
    """The SQL of DuckDB for what a field is once a record has been through the archive's log."""
    m = MAPS[archive]
    if field == "archive_code":
        return f"'{archive}'"
    if field in m.back:
        return m.back[field]
    return m.fields[field].back.replace("{f}", field) if field in m.fields else "NULL"
