"""DuckDB statements giving the expected result of each registered query."""

from __future__ import annotations

EVENT_BANDS = "['B','R','I','g','r','i','g''','r''','i''','V','clear']"

# Observations, supported light curves and candidates of the ``events`` fixture.
EVENTS = f"""
ev AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k,
         {EVENT_BANDS}[CAST(event_id % 11 AS INT) + 1] AS band_raw,
         epoch_us(ts) / 86400000000.0::DOUBLE + 40587.0::DOUBLE AS mjd
  FROM events),
obs AS (
  SELECT CAST(user_id AS VARCHAR) AS name, event_id AS pos, band_raw, replace(band_raw, '''', '_pr') AS band,
         mjd AS time, value AS flux, CASE WHEN k % 3 <> 0 THEN value * (k + 1) / 1000.0::DOUBLE END AS e_flux,
         k % 5 = 0 AS upperlimit
  FROM ev),
lc AS (SELECT * FROM obs WHERE band NOT IN ('V', 'clear')),
cand AS (
  SELECT CAST(c_custkey - 1 AS VARCHAR) AS name, (c_custkey - 1) % 17 <> 0 AS has_photometry FROM customer)"""

MAGNITUDES = """
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS name, event_id AS pos,
         CASE WHEN event_id % 3 <> 1 THEN value / 50.0::DOUBLE END AS m0,
         CASE WHEN event_id % 2 = 1 THEN value END AS f0,
         CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 4 <> 0
              THEN CAST(json_extract(props, '$.k') AS INT) / 100.0::DOUBLE + 1 ELSE 1.0::DOUBLE END AS zp
  FROM events),
derived AS (
  SELECT name, pos, zp,
         coalesce(f0, zp * pow(10.0::DOUBLE, m0 * -0.4::DOUBLE)) AS flux,
         coalesce(m0, CASE WHEN f0 > 0 THEN log10(f0 / zp) * -2.5::DOUBLE END) AS magnitude
  FROM raw)"""

LINEITEMS = """
lc AS (
  SELECT * FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS name, l_orderkey * 10 + l_linenumber AS pos,
           CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'B' WHEN 'NF' THEN 'R' WHEN 'RF' THEN 'I'
                WHEN 'AO' THEN 'g' WHEN 'NO' THEN 'r' WHEN 'RO' THEN 'i' END AS band,
           epoch_us(l_shipdate) / 86400000000.0::DOUBLE + 40587.0::DOUBLE AS time,
           l_extendedprice AS flux, l_discount * l_extendedprice AS e_flux, l_tax = 0 AS upperlimit
    FROM lineitem)
  WHERE band IS NOT NULL AND time IS NOT NULL AND flux IS NOT NULL)"""


def bins(width: int) -> str:
    """Two-pass restatement of the binning rules over ``lc``."""
    return f"""
pts AS (
  SELECT *, CAST(floor(time / {width}) AS BIGINT) AS bin_id, NOT upperlimit AND e_flux IS NOT NULL AS sampled,
         CASE WHEN NOT upperlimit AND e_flux <> 0 THEN 1 / (e_flux * e_flux) END AS w
  FROM lc),
means AS (
  SELECT *, sum(w * flux) OVER bin / sum(w) OVER bin AS mu,
         row_number() OVER (PARTITION BY name, band, bin_id ORDER BY upperlimit DESC, flux, pos) AS limit_rank
  FROM pts WINDOW bin AS (PARTITION BY name, band, bin_id)),
grouped AS (
  SELECT name, band, bin_id, count(*) AS n_obs, count(*) FILTER (NOT upperlimit) AS n_det,
         count(*) FILTER (sampled) AS n_errors, count(*) FILTER (sampled AND w IS NULL) AS n_zero,
         max(CASE WHEN limit_rank = 1 THEN flux END) AS limit_flux,
         max(CASE WHEN limit_rank = 1 THEN e_flux END) AS limit_error,
         avg(flux) FILTER (NOT upperlimit) AS plain_mean,
         max(flux) FILTER (sampled) AS single_flux, max(e_flux) FILTER (sampled) AS single_error,
         max(mu) AS mu, sqrt(sum(w * (flux - mu) * (flux - mu)) / sum(w) / (count(*) FILTER (sampled) - 1)) AS sigma,
         1 / sqrt(sum(w)) AS typical
  FROM means GROUP BY name, band, bin_id),
bins AS (
  SELECT name, band, bin_id, bin_id * {width}.0::DOUBLE + {width} / 2.0::DOUBLE AS time,
         {width} / 2.0::DOUBLE AS e_time, n_obs, n_errors, n_det = 0 AS upperlimit,
         CASE WHEN n_det = 0 THEN 'upper limit' WHEN n_errors = 0 THEN 'plain mean'
              WHEN n_errors = 1 THEN 'single' ELSE 'weighted' END AS method,
         CASE WHEN n_zero = 0 THEN mu END AS weighted_mean, CASE WHEN n_zero = 0 THEN sigma END AS sigma,
         CASE WHEN n_zero = 0 THEN typical END AS typical_error,
         CASE WHEN n_det = 0 THEN limit_flux WHEN n_errors = 0 THEN plain_mean
              WHEN n_errors = 1 THEN single_flux WHEN n_zero = 0 THEN mu END AS flux,
         CASE WHEN n_det = 0 THEN limit_error WHEN n_errors = 0 THEN NULL
              WHEN n_errors = 1 THEN single_error
              WHEN n_zero = 0 THEN CASE WHEN typical > sigma THEN (sigma + typical) / 2 ELSE sigma END END AS e_flux
  FROM grouped)"""


BANDSET_ROWS = {
    "BRI": ("B", "R", "I"),
    "gri": ("g", "r", "i"),
    "gri_primed": ("g_pr", "r_pr", "i_pr"),
}
ALL_BANDS = {"all": ("B", "R", "I", "g", "r", "i", "g_pr", "r_pr", "i_pr")}


def verdicts(minimum: int, bandsets=None, width: int = 3, suffix: str = "") -> str:
    """``bs`` (per band set) and ``res`` (per candidate) over ``lc`` and ``cand``."""
    values = ", ".join(
        f"({s}, '{bandset}', {b}, '{band}')"
        for s, (bandset, members) in enumerate((bandsets or BANDSET_ROWS).items())
        for b, band in enumerate(members)
    )
    return f"""
dim{suffix}(set_pos, bandset, band_pos, band) AS (VALUES {values}),
st{suffix} AS (
  SELECT name, band, count(*) AS n_obs, count(DISTINCT CAST(floor(time / {width}) AS BIGINT)) AS n_bins
  FROM lc GROUP BY name, band),
slots{suffix} AS (
  SELECT c.name, d.*, coalesce(n_obs, 0) AS n_obs, coalesce(n_bins, 0) AS n_bins
  FROM cand c CROSS JOIN dim{suffix} d LEFT JOIN st{suffix} s ON s.name = c.name AND s.band = d.band
  WHERE c.has_photometry),
bs{suffix} AS (
  SELECT name, set_pos, bandset, count(*) FILTER (n_bins < {minimum}) = 0 AS is_valid,
         min_by('Band [' || band || '] has only ' || n_obs || ' observation(s) (minimum: {minimum})', band_pos)
           FILTER (n_bins < {minimum}) AS message
  FROM slots{suffix} GROUP BY name, set_pos, bandset),
res{suffix} AS (
  SELECT c.name, c.has_photometry AND bool_or(b.is_valid) AS is_valid,
         CASE WHEN NOT c.has_photometry THEN 'No photometry data available'
              WHEN NOT bool_or(b.is_valid) THEN string_agg(b.message, chr(10) ORDER BY set_pos) END AS message,
         string_agg(b.bandset, ',' ORDER BY set_pos) FILTER (b.is_valid) AS available
  FROM cand c LEFT JOIN bs{suffix} b ON b.name = c.name GROUP BY c.name, c.has_photometry)"""


TWO_CHECKS = (
    verdicts(4, suffix="4")
    + ","
    + verdicts(5, suffix="5")
    + """,
results AS (
  SELECT name, 0 AS check_pos, 'MinimumObservationsPerBand' AS check_name, is_valid, message FROM res4
  UNION ALL
  SELECT name, 1, 'MinimumObservationsPerBand', is_valid, message FROM res5)"""
)

REPORT = """
SELECT name, CAST(line_pos AS INT) AS line_pos, line FROM (
  SELECT name, 0 AS line_pos, '### ' || name || ' ###' AS line FROM results GROUP BY name {having}
  UNION ALL
  SELECT name, row_number() OVER (PARTITION BY name ORDER BY check_pos),
         'Check failed: [check=' || check_name || '; message=' || coalesce(message, 'None') || ']'
  FROM results WHERE NOT is_valid
  {passed})"""

# Objects of the JSON catalogue: one per user and block of event ids, some of them broken.
OBJECTS = (
    EVENTS
    + """,
rows AS (
  SELECT *, user_id || '.' || event_id // 2000 AS stem, user_id % 29 AS defect,
         row_number() OVER (PARTITION BY user_id, event_id // 2000 ORDER BY event_id) - 1 AS p,
         CASE WHEN event_id % 10 = 0 THEN ((mjd - 0.5::DOUBLE) + (mjd + 0.5::DOUBLE)) / 2 ELSE mjd END AS t
  FROM ev),
objects AS (
  SELECT stem, any_value(defect) AS defect, bool_or(event_id % 3 <> 1) AS has_magnitude FROM rows GROUP BY stem),
checked AS (
  SELECT *, CASE WHEN defect = 2 THEN 'schema'
                 WHEN defect IN (1, 4, 5, 6, 7) OR (defect = 3 AND has_magnitude) THEN 'invalid' END AS reason,
         CASE WHEN defect IN (1, 5) THEN 'not a JSON object'
              WHEN defect = 2 THEN 'no entry named like the file'
              WHEN defect = 6 THEN 'schema: missing'
              WHEN defect IN (4, 7) OR (defect = 3 AND has_magnitude) THEN 'photometry: malformed' END AS detail
  FROM objects),
good AS (
  SELECT rows.*, CASE WHEN k % 4 <> 0 THEN k / 100.0::DOUBLE + 1 ELSE 1.0::DOUBLE END AS zp,
         CASE WHEN event_id % 2 = 1 THEN value END AS f0,
         CASE WHEN event_id % 3 <> 1 AND defect <> 3 THEN value / 50.0::DOUBLE END AS m0
  FROM rows SEMI JOIN (SELECT stem FROM checked WHERE reason IS NULL) USING (stem)),
catalog_obs AS (
  SELECT stem AS name, p AS pos, t AS time, band_raw,
         coalesce(f0, zp * pow(10.0::DOUBLE, m0 * -0.4::DOUBLE)) AS flux,
         coalesce(m0, CASE WHEN f0 > 0 THEN log10(f0 / zp) * -2.5::DOUBLE END) AS magnitude,
         CASE WHEN k % 3 <> 0 THEN value * (k + 1) / 1000.0::DOUBLE END AS e_flux,
         zp AS zeropoint, k % 5 = 0 AS upperlimit
  FROM good)"""
)

CATALOG_OBSERVATIONS = f"""
WITH {OBJECTS}
SELECT name, CAST(pos AS INT) AS pos, time, band_raw, round(flux, 9) AS flux, round(magnitude, 9) AS magnitude,
       round(e_flux, 6) AS e_flux, zeropoint, upperlimit
FROM catalog_obs"""

LOGS = """
lines AS (
  SELECT event_id, event_type || ' for user ' || user_id AS text,
         '{"text":"' || event_type || ' for user ' || user_id || '","level":"'
         || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","event_id":' || event_id || '}' AS value
  FROM events)"""

BAND_SELECTION = """
SELECT c.name, d.band_pos, d.band, lc.pos, lc.time, lc.flux
FROM cand c CROSS JOIN dim d LEFT JOIN lc ON lc.name = c.name AND lc.band = d.band"""


def band_dimension(bands) -> str:
    return "dim(band_pos, band) AS (VALUES " + ", ".join(f"({i}, '{band}')" for i, band in enumerate(bands)) + ")"


def event_bins(method: str) -> str:
    return f"""WITH {EVENTS}, {bins(3)}
SELECT name, band, bin_id, round(flux, 6) AS flux, round(e_flux, 6) AS e_flux, upperlimit, n_obs
FROM bins WHERE method = '{method}'"""


def lineitem_statistic(column: str) -> str:
    return f"""WITH {LINEITEMS}, {bins(30)}
SELECT name, band, bin_id, n_errors, round({column}, 4) AS {column} FROM bins WHERE method = 'weighted'"""


def event_verdicts(select: str, minimum: int = 4, bandsets=None) -> str:
    return f"WITH {EVENTS}, {verdicts(minimum, bandsets)} {select}"


def two_checks(select: str) -> str:
    return f"WITH {EVENTS}, {TWO_CHECKS} {select}"


CATALOG_CURVES = f"""{OBJECTS.replace("lc AS (", "event_lc AS (")},
lc AS (
  SELECT *, replace(band_raw, '''', '_pr') AS band FROM catalog_obs
  WHERE flux IS NOT NULL AND band_raw NOT IN ('V', 'clear'))"""

CATALOG_VERDICTS = f"""{CATALOG_CURVES.replace("cand AS (", "event_cand AS (")},
cand AS (SELECT stem AS name, TRUE AS has_photometry FROM checked WHERE reason IS NULL), {verdicts(1)}"""

ORACLES: dict[str, str] = {
    "flux_from_magnitude": f"WITH {MAGNITUDES} SELECT name, pos, round(flux, 9) AS flux FROM derived",
    "magnitude_from_flux": f"WITH {MAGNITUDES} SELECT name, pos, round(magnitude, 9) AS magnitude FROM derived",
    "zeropoint_default": f"""WITH {MAGNITUDES}
SELECT name, count(*) FILTER (zp = 1) AS n_default, count(zp) AS n_zeropoint FROM derived GROUP BY name""",
    "valid_observations": f"""WITH {MAGNITUDES}
SELECT name, pos FROM derived WHERE flux IS NOT NULL AND pos % 7 <> 3 AND pos % 5 <> 0""",
    "normalise_bands": f"WITH {EVENTS} SELECT name, pos, band_raw, band FROM obs",
    "supported_bands": f"WITH {EVENTS} SELECT name, pos, band FROM lc",
    "light_curve_points": f"""WITH {EVENTS}
SELECT name, band, pos, time, CAST(NULL AS DOUBLE) AS e_time, flux, e_flux, upperlimit FROM lc""",
    "band_counts": f"WITH {EVENTS} SELECT name, band, count(*) AS n_obs FROM lc GROUP BY name, band",
    "candidate_counts": f"""WITH {EVENTS}
SELECT name, count(lc.pos) AS n_obs FROM cand LEFT JOIN lc USING (name) GROUP BY name""",
    "all_bands": f"WITH {EVENTS}, {band_dimension(ALL_BANDS['all'])} {BAND_SELECTION}",
    "valid_candidate_bands": two_checks(
        f""", {band_dimension(ALL_BANDS['all'])}, valid AS (
  SELECT * FROM cand WHERE name NOT IN (SELECT name FROM results WHERE NOT is_valid))
{BAND_SELECTION.replace("FROM cand c", "FROM valid c")}"""
    ),
    "bandset_bands": f"WITH {EVENTS}, {band_dimension(BANDSET_ROWS['gri_primed'])} {BAND_SELECTION}",
    "band_arrays": f"""WITH {CATALOG_CURVES}
SELECT name, band, count(*) AS n_points,
       string_agg(CAST(CAST(round(flux * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS flux,
       string_agg(coalesce(CAST(CAST(round(e_flux * 1000) AS BIGINT) AS VARCHAR), 'null'), ',' ORDER BY pos) AS e_flux,
       string_agg(CAST(CAST(upperlimit AS INT) AS VARCHAR), ',' ORDER BY pos) AS upperlimit
FROM lc GROUP BY name, band""",
    "band_matrix": f"""WITH {CATALOG_CURVES}
SELECT name, band, CAST(4 AS BIGINT) AS n_rows, count(*) AS n_columns,
       round(arg_min(flux, pos), 6) AS first_flux, round(arg_max(flux, pos), 6) AS last_flux
FROM lc GROUP BY name, band""",
    "bin_assignment": f"""WITH {EVENTS}
SELECT name, band, pos, CAST(floor(time / 3) AS BIGINT) AS bin_id, floor(time / 3) * 3 + 1.5::DOUBLE AS bin_centre
FROM lc""",
    "bins_all_upper_limits": event_bins("upper limit"),
    "bins_without_errors": event_bins("plain mean"),
    "bins_single_point": event_bins("single"),
    "bins_weighted": event_bins("weighted"),
    "weighted_mean": lineitem_statistic("weighted_mean"),
    "weighted_sigma": lineitem_statistic("sigma"),
    "typical_error": lineitem_statistic("typical_error"),
    "binned_light_curve": f"""WITH {EVENTS}, {bins(3)}
SELECT name, band, bin_id, time, e_time, round(flux, 6) AS flux, round(e_flux, 6) AS e_flux, upperlimit, n_obs
FROM bins""",
    "binned_growing": f"""WITH {EVENTS}, {bins(3)}
SELECT name, band, bin_id, time, e_time, round(flux, 6) AS flux, round(e_flux, 6) AS e_flux, upperlimit, n_obs
FROM bins""",
    "binned_light_curve_volume": f"""WITH {LINEITEMS}, {bins(30)}
SELECT name, band, bin_id, time, e_time, round(flux, 4) AS flux, round(e_flux, 4) AS e_flux, upperlimit, n_obs
FROM bins""",
    "band_statistics": f"""WITH {EVENTS}
SELECT name, band, count(*) AS n_obs, count(DISTINCT CAST(floor(time / 3) AS BIGINT)) AS n_bins
FROM lc GROUP BY name, band""",
    "photometry_presence": event_verdicts(
        "SELECT name, is_valid, message FROM res WHERE message = 'No photometry data available'"
    ),
    "min_observations_verdicts": event_verdicts("SELECT name, is_valid, message FROM res"),
    "min_observations_volume": f"""WITH {LINEITEMS},
cand AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, TRUE AS has_photometry FROM supplier),
{verdicts(55, {name: BANDSET_ROWS[name] for name in ("BRI", "gri")}, 30)}
SELECT name, is_valid, message FROM res""",
    "bandset_messages": event_verdicts("SELECT name, bandset, is_valid, message FROM bs"),
    "no_bandsets": f"""WITH {EVENTS}
SELECT name, FALSE AS is_valid, CASE WHEN has_photometry THEN '' ELSE 'No photometry data available' END AS message
FROM cand""",
    "every_band_verdicts": event_verdicts("SELECT name, is_valid, message FROM res", bandsets=ALL_BANDS),
    "available_bandsets": event_verdicts(
        """SELECT name, CASE WHEN has_photometry THEN coalesce(available, '') END AS available
FROM res JOIN cand USING (name)"""
    ),
    "bandset_flags": event_verdicts(
        """SELECT name, coalesce(bool_or(bs.is_valid) FILTER (bandset = 'BRI'), FALSE) AS "BRI",
       coalesce(bool_or(bs.is_valid) FILTER (bandset = 'gri'), FALSE) AS gri,
       coalesce(bool_or(bs.is_valid) FILTER (bandset = 'gri_primed'), FALSE) AS gri_primed
FROM cand LEFT JOIN bs USING (name) GROUP BY name"""
    ),
    "check_results": two_checks("SELECT * FROM results"),
    "check_results_fail_fast": two_checks(
        """SELECT * FROM results r
WHERE NOT EXISTS (SELECT 1 FROM results e WHERE e.name = r.name AND e.check_pos < r.check_pos AND NOT e.is_valid)"""
    ),
    "candidate_validity": two_checks("SELECT name, bool_and(is_valid) AS is_valid FROM results GROUP BY name"),
    "valid_candidates": two_checks(
        "SELECT * FROM cand WHERE name NOT IN (SELECT name FROM results WHERE NOT is_valid)"
    ),
    "validation_report": two_checks(
        REPORT.format(
            having="",
            passed="UNION ALL SELECT name, 1, 'Passed.' FROM results GROUP BY name HAVING bool_and(is_valid)",
        )
    ),
    "validation_report_errors": two_checks(REPORT.format(having="HAVING NOT bool_and(is_valid)", passed="")),
    "valid_ratio": event_verdicts(
        """SELECT count(*) FILTER (is_valid) AS n_valid, count(*) AS n_total,
       round(count(*) FILTER (is_valid) * 100.0::DOUBLE / count(*), 6) AS percent_valid FROM res"""
    ),
    "valid_ratio_nominal": event_verdicts(
        """SELECT count(*) FILTER (is_valid) AS n_valid, CAST(45162 AS BIGINT) AS n_total,
       round(count(*) FILTER (is_valid) * 100.0::DOUBLE / 45162, 6) AS percent_valid FROM res"""
    ),
    "csv_export": event_verdicts(
        """SELECT name, CASE WHEN bool_or(bs.is_valid) FILTER (bandset = 'BRI') THEN 'True' ELSE 'False' END AS "BRI",
       CASE WHEN bool_or(bs.is_valid) FILTER (bandset = 'gri') THEN 'True' ELSE 'False' END AS gri,
       CASE WHEN bool_or(bs.is_valid) FILTER (bandset = 'gri_primed') THEN 'True' ELSE 'False' END AS "g'r'i'"
FROM bs GROUP BY name HAVING bool_or(bs.is_valid)"""
    ),
    "catalog_files": f"WITH {OBJECTS} SELECT stem || '.json' AS file_name FROM objects",
    "catalog_load": CATALOG_OBSERVATIONS,
    "catalog_load_object": f"{CATALOG_OBSERVATIONS} WHERE name = '0.0'",
    "catalog_table_object": f"{CATALOG_OBSERVATIONS} WHERE name = '0.0'",
    "catalog_format_load": CATALOG_OBSERVATIONS,
    "catalog_format_rejects": f"""WITH {OBJECTS}
SELECT stem AS file_stem, 'schema' AS reason, 'no photometric column names' AS detail FROM checked WHERE reason IS NOT NULL""",
    "catalog_stream": f"""WITH {OBJECTS},
ranked AS (SELECT row_number() OVER (ORDER BY stem) - 1 AS i FROM objects)
SELECT i // 100 AS batch_id, count(*) AS n_objects FROM ranked GROUP BY i // 100""",
    "catalog_stream_objects": f"""WITH {OBJECTS}
SELECT stem AS file_stem, defect NOT IN (1, 2, 5) AS has_photometry, reason FROM checked""",
    "catalog_summary": f"""WITH {OBJECTS},
dim(catalog, path, nr_datapoints, parity) AS (
  VALUES ('OSC-2018-June', 'datasets/osc2018_june', CAST(45162 AS BIGINT), 0),
         ('OSC-2022', 'datasets/osc2022', CAST(108921 AS BIGINT), 1))
SELECT catalog, path, nr_datapoints, count(stem) FILTER (reason IS NULL) AS n_loaded, count(reason) AS n_rejected
FROM dim LEFT JOIN checked ON length(stem) % 2 = parity GROUP BY catalog, path, nr_datapoints""",
    "catalog_ingest": CATALOG_OBSERVATIONS,
    "catalog_verdicts": f"WITH {CATALOG_VERDICTS} SELECT name, is_valid, message, coalesce(available, '') AS available FROM res",
    "catalog_stream_valid": f"""WITH {CATALOG_VERDICTS}
SELECT name, bool_or(bandset = 'BRI' AND is_valid) AS "BRI", bool_or(bandset = 'gri' AND is_valid) AS "gri",
       bool_or(bandset = 'gri_primed' AND is_valid) AS "g'r'i'"
FROM bs GROUP BY name HAVING bool_or(is_valid)""",
    "catalog_stream_batches": f"""WITH {OBJECTS}
SELECT object_batch, count(*) AS n_objects
FROM (SELECT CASE WHEN reason IS NULL THEN (row_number() OVER (PARTITION BY reason IS NULL) - 1) // 100 END AS object_batch
      FROM checked) GROUP BY object_batch""",
    "catalog_candidates": f"""WITH {OBJECTS}
SELECT stem AS file_stem, stem AS name, 'v1.0' AS schema, TRUE AS has_photometry FROM checked WHERE reason IS NULL""",
    "catalog_rejects": f"""WITH {OBJECTS}
SELECT stem AS file_stem, reason, detail FROM checked WHERE reason IS NOT NULL""",
    "time_midpoint": f"WITH {OBJECTS} SELECT name, CAST(pos AS INT) AS pos, time FROM catalog_obs",
    "field_defaults": f"""WITH {OBJECTS}
SELECT stem AS name, count(*) AS n_nan_e_time, count(*) FILTER (k % 3 = 0) AS n_nan_e_flux,
       count(*) FILTER (k % 5 <> 0) AS n_not_limit, count(*) FILTER (k % 4 = 0) AS n_no_zeropoint
FROM good GROUP BY stem""",
    "sources_long": f"""WITH {OBJECTS},
types AS (SELECT DISTINCT stem, event_type FROM good),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY event_type) AS i FROM types)
SELECT stem AS name, CAST(i - 1 AS INT) AS pos, i AS alias, event_type AS source_name,
       event_type = 'error' AS secondary FROM numbered""",
    "quantities_long": f"""WITH {OBJECTS}
SELECT stem AS name, 'redshift' AS quantity,
       CAST(row_number() OVER (PARTITION BY stem ORDER BY event_id) - 1 AS INT) AS pos,
       CAST(value AS VARCHAR) AS value_str, value AS value_num, '1' AS source, CAST(k AS DOUBLE) AS e_value,
       NULL AS correlation_quantity, CAST(NULL AS DOUBLE) AS correlation_value
FROM good WHERE event_id % 7 = 0
UNION ALL
SELECT stem, 'claimedtype', CAST(row_number() OVER (PARTITION BY stem ORDER BY event_id) - 1 AS INT),
       event_type, NULL, '1', NULL, 'redshift', CAST(k AS DOUBLE)
FROM good WHERE event_id % 11 = 0""",
    "spectra_long": f"""WITH {OBJECTS}
SELECT stem AS name, CAST(0 AS INT) AS pos, 53000.5::DOUBLE AS time, 'Angstrom' AS u_wavelengths,
       'Uncalibrated' AS u_fluxes, 9000.5::DOUBLE AS exclude_above, count(*) FILTER (event_id % 3 = 0) AS n_points
FROM good GROUP BY stem""",
    "spectrum_points": f"""WITH {OBJECTS}
SELECT stem AS name, CAST(row_number() OVER (PARTITION BY stem ORDER BY event_id) - 1 AS INT) AS point_pos,
       CAST(event_id AS DOUBLE) AS wavelength, value AS flux
FROM good WHERE event_id % 3 = 0""",
    "catalog_binned": f"""WITH {CATALOG_CURVES}, {bins(3)}
SELECT name, band, bin_id, round(flux, 6) AS flux, round(e_flux, 6) AS e_flux, upperlimit, n_obs FROM bins""",
    "log_files": f"WITH {LOGS} SELECT value FROM lines",
    "log_keyword": f"WITH {LOGS} SELECT event_id, value FROM lines WHERE contains(value, 'error')",
    "log_keyword_negated": f"WITH {LOGS} SELECT event_id, value FROM lines WHERE NOT contains(value, 'click')",
    "log_unfiltered": f"WITH {LOGS} SELECT event_id, value FROM lines",
    "log_text": f"WITH {LOGS} SELECT event_id, text FROM lines",
    "log_numbering": f"""WITH {LOGS}
SELECT row_number() OVER (ORDER BY event_id) AS number, value FROM lines WHERE contains(value, 'click')""",
    "log_collection": f"""WITH {LOGS}
SELECT row_number() OVER (ORDER BY event_id) AS number, value AS record, text, 'errors' AS collection
FROM lines WHERE contains(value, 'error')""",
    "plot_series": f"""WITH {EVENTS}
SELECT name, CASE WHEN band IN ('B', 'R', 'I') THEN 'BRI' WHEN band IN ('g', 'r', 'i') THEN 'gri'
                  ELSE 'gri_primed' END AS bandset,
       band AS series, time AS x, flux AS y, e_flux AS y_error
FROM lc""",
    "plot_series_binned": f"""WITH {EVENTS}, {bins(3)}
SELECT name, CASE WHEN band IN ('B', 'R', 'I') THEN 'BRI' ELSE 'gri' END AS bandset, band AS series, time AS x,
       round(flux, 6) AS y, round(e_flux, 6) AS y_error
FROM bins WHERE band IN ('B', 'R', 'I', 'g', 'r', 'i')""",
}
