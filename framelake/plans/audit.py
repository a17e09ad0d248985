"""Queries of the rule engine: facts made from the driver's tables, and each rule once more as DuckDB SQL.

The facts are one SELECT that both engines run; the predicates below are written from the rules' wording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, delivery, ladder
from ..operators.samples import read

#: Facts of a file from a part: what a rule needs, spread so that every branch of a rule is met.
FILE_FACTS = """SELECT p_partkey AS entity,
  p_partkey % 5 <> 0 AS is_mp4, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 100 END AS moov, p_partkey * 99 + p_partkey % 7 * 60 AS mdat, p_partkey % 6 = 0 AS fragmented,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS drift, p_partkey % 5 AS edits, greatest(p_partkey % 9 - 5, 0) AS bad_insights, p_partkey * 7 AS bad_offset,
  p_partkey % 13 % 3 AS videos, p_partkey % 17 % 2 AS audios, CAST(p_size AS DOUBLE) AS video_seconds, CAST(p_size AS DOUBLE) + CAST(p_partkey % 9 AS DOUBLE) / 8 - 0.125 AS audio_seconds,
  CASE p_partkey % 5 WHEN 0 THEN 'avc' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'vp9' ELSE 'avc' END AS family,
  CASE p_partkey % 6 WHEN 0 THEN 66 WHEN 1 THEN 77 WHEN 2 THEN 110 WHEN 3 THEN NULL ELSE 100 END AS profile,
  CASE p_partkey % 4 WHEN 0 THEN '3.1' WHEN 1 THEN '4' WHEN 2 THEN '5.2' END AS level_name, CASE p_partkey % 4 WHEN 0 THEN 31 WHEN 1 THEN 40 WHEN 2 THEN 62 END AS level_idc,
  CASE p_partkey % 7 WHEN 0 THEN NULL ELSE p_partkey % 7 < 5 END AS level_fits, p_partkey % 19 = 0 AS unconstrained, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '3.1' ELSE '4' END END AS lowest_level,
  p_size * 40 + p_partkey % 2 AS width, p_size * 22 + p_partkey % 8 AS height, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 END AS sar_w, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 END AS sar_h,
  CAST(p_size AS DOUBLE) * 1.5 AS fps, CASE WHEN p_partkey % 8 > 0 THEN p_partkey % 8 < 3 END AS vfr,
  p_partkey % 6 AS gops, p_partkey % 6 * 3 AS counted_gops, p_partkey % 4 AS odd_gops, p_partkey % 7 < 4 AS odd_all_shorter, p_partkey * 5 AS odd_offset, CAST(p_size AS DOUBLE) / 12 AS gop_seconds, CAST(p_size AS DOUBLE) / 8 AS gop_max_seconds,
  p_partkey % 3 AS classified, p_partkey % 5 % 3 AS open_gops, p_partkey % 7 % 2 AS keys_not_rap, p_partkey % 4 AS max_b,
  p_partkey % 9 * 100000 AS avg_rate, p_size AS seconds, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 23 * 100000 END AS segment_rate, CAST(p_partkey % 5 AS DOUBLE) AS second_ratio,
  CASE p_partkey % 5 WHEN 0 THEN 'crf' WHEN 1 THEN 'capped-crf' WHEN 2 THEN 'abr' WHEN 3 THEN 'cbr' END AS rc_mode, p_partkey % 10 * 100 AS maxrate, p_partkey % 3 * 500 AS bufsize, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 * 20 END AS scenecut,
  CAST(p_partkey % 13 AS DOUBLE) / 256 AS bpp, p_partkey % 4 > 0 AS has_sps,
  CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 2 END END AS primaries, CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 5 WHEN 0 THEN 16 WHEN 1 THEN 18 WHEN 2 THEN 2 ELSE 1 END END AS transfer,
  CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 2 WHEN 2 THEN 10 ELSE 1 END END AS matrix, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 2 = 0 END AS full_range, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 * 2 + 2 END AS depth,
  CASE p_partkey % 6 WHEN 0 THEN 'isom,mp42' WHEN 1 THEN 'qt  ' WHEN 2 THEN 'cmfc,iso6' WHEN 3 THEN 'abcd' WHEN 4 THEN 'M4V ,cmf2' END AS brand_list,
  p_size * 40 AS display_width, p_size * (20 + p_partkey % 5) AS display_height, (CAST(p_size AS DOUBLE) * 40 + p_partkey % 2) / (p_size * 22 + p_partkey % 8) AS aspect,
  p_partkey % 2 = 0 AS has_entry_boxes, p_partkey % 4 < 2 AS has_mdcv, p_partkey % 8 < 4 AS has_clli, p_partkey % 3 AS moofs, p_partkey % 7 % 3 AS fragment_problems, p_partkey % 5 % 2 AS underflows, p_partkey % 4 AS frames,
  CASE p_partkey % 4 WHEN 0 THEN 'AAC LC' WHEN 1 THEN 'HE-AAC' WHEN 2 THEN 'Opus' END AS audio_codec, CASE p_partkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 22050 END AS sample_rate, p_partkey % 5 AS channels, p_partkey % 7 * 32000 AS audio_bitrate,
  CASE p_partkey % 3 WHEN 0 THEN 'isobmff' WHEN 1 THEN 'matroska' ELSE 'mpegts' END AS format, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 - 1 AS DOUBLE) * 10.5 END AS priming_ms,
  CASE WHEN p_partkey % 3 > 0 THEN -24 + CAST(p_size AS DOUBLE) / 4 END AS loudness, CASE WHEN p_partkey % 3 > 1 THEN -4 + CAST(p_size AS DOUBLE) / 8 END AS true_peak, CASE WHEN p_partkey % 4 > 1 THEN p_size * 10 - 200 END AS audio_late_ms,
  CASE WHEN p_partkey % 4 > 1 THEN p_size END AS psnr, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_size AS DOUBLE) / 64 + 0.25 END AS ssim, CASE WHEN p_partkey % 6 > 4 THEN p_size * 2 END AS vmaf,
  CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 6 - 1 END AS decode_errors, p_partkey % 29 = 0 AS decode_failed, p_partkey * 11 AS entry_offset, p_partkey * 13 AS sei_offset
FROM part"""

PROFILE = {
    "fpsMin": 6, "gop": 2.5, "gopMax": 4, "audio": {"codec": "AAC LC", "channelsMax": 1}, "loudness": {"integrated": -18, "tolerance": 2}, "colour": {"primaries": 1, "matrix": 9},
    "overlay": {"severity": {"square-pixels": "critical", "profile": "info"}, "levelCap": [{"height": 300, "fpsMax": 30, "level": 3.1}, {"height": 700, "level": 4}]},
}


def _cases(rows: dict[str, str], of: str) -> str:
    return " UNION ALL ".join(f"SELECT entity, '{k}' AS id, {sql} AS level FROM {of}" for k, sql in rows.items())


#: Each rule as its wording has it: null where it doesn't apply. The values of PROFILE stand in it.
FILE_SQL = {
    "fast-start": "CASE WHEN is_mp4 AND NOT fragmented AND moov IS NOT NULL THEN CASE WHEN mdat > moov THEN 'pass' ELSE 'fail' END END",
    "interleaved": "CASE WHEN drift > 2 THEN 'warn' WHEN drift IS NOT NULL THEN 'pass' END",
    "edit-list": "CASE WHEN edits >= 2 THEN 'warn' END",
    "integrity": "CASE WHEN NOT is_mp4 THEN NULL WHEN bad_insights > 0 THEN 'fail' ELSE 'pass' END",
    "one-video-track": "CASE WHEN videos = 0 THEN 'fail' WHEN videos > 1 THEN 'warn' ELSE 'pass' END",
    "has-audio": "CASE WHEN audios = 0 THEN 'info' END",
    "track-durations": "CASE WHEN video_seconds > 0 AND audio_seconds > 0 THEN CASE WHEN abs(audio_seconds - video_seconds) > 0.5 THEN 'fail' WHEN abs(audio_seconds - video_seconds) > 0.1 THEN 'warn' ELSE 'pass' END END",
    "codec": "CASE WHEN videos > 0 THEN CASE WHEN family = 'vp9' THEN 'fail' ELSE 'pass' END END",
    "profile": "CASE WHEN family = 'avc' THEN CASE profile WHEN 100 THEN 'pass' WHEN 77 THEN 'warn' WHEN 66 THEN 'warn' WHEN 110 THEN 'fail' END END",
    "level-holds": "CASE WHEN level_name IS NOT NULL AND NOT unconstrained THEN CASE WHEN level_fits IS FALSE THEN 'fail' ELSE 'pass' END END",
    "level-minimal": "CASE WHEN NOT unconstrained AND level_name <> lowest_level THEN 'warn' WHEN NOT unconstrained AND level_name = lowest_level THEN 'pass' END",
    "level-policy": "CASE WHEN level_name IS NULL OR height > 700 THEN NULL WHEN level_name::DOUBLE <= CASE WHEN height <= 300 AND fps <= 30.01 THEN 3.1 ELSE 4 END THEN 'pass' ELSE 'fail' END",
    "level-cap": "CASE WHEN family = 'avc' AND level_idc > 52 THEN 'fail' WHEN family = 'avc' AND level_idc <= 52 THEN 'pass' END",
    "even-size": "CASE WHEN width & 1 = 0 AND height & 1 = 0 THEN 'pass' ELSE 'fail' END",
    "square-pixels": "CASE WHEN sar_w * sar_h = 0 THEN 'pass' WHEN sar_w = sar_h THEN 'pass' WHEN sar_w <> sar_h THEN 'warn' END",
    "fps-range": "CASE WHEN fps > 60.01 THEN 'fail' WHEN fps < 6 THEN 'warn' ELSE 'pass' END",
    "fps-constant": "CASE WHEN vfr THEN 'warn' WHEN NOT vfr THEN 'pass' END",
    "gop-fixed": "CASE WHEN gops < 2 THEN NULL WHEN odd_gops = 0 THEN 'pass' WHEN odd_all_shorter AND odd_gops <= greatest(2, ceil(counted_gops * 0.05)) THEN 'info' ELSE 'warn' END",
    "gop-length": "CASE WHEN gops < 2 THEN NULL WHEN gop_seconds BETWEEN 2.45 AND 2.55 THEN 'pass' ELSE 'fail' END",
    "gop-max": "CASE WHEN gops < 2 THEN NULL WHEN gop_max_seconds > 4.05 THEN 'fail' ELSE 'pass' END",
    "closed-gop": "CASE WHEN classified = 0 OR gops = 0 THEN NULL WHEN open_gops > 0 THEN 'warn' ELSE 'pass' END",
    "key-is-idr": "CASE WHEN classified > 0 THEN CASE WHEN keys_not_rap > 0 THEN 'fail' ELSE 'pass' END END",
    "b-frames": "CASE WHEN classified > 0 AND max_b > 0 THEN CASE WHEN profile = 66 AND family = 'avc' THEN 'fail' ELSE 'info' END END",
    "peak-ratio": "CASE WHEN avg_rate = 0 OR seconds < 3 THEN NULL WHEN segment_rate IS NULL THEN CASE WHEN second_ratio > 2 THEN 'warn' ELSE 'pass' END WHEN segment_rate > 2 * avg_rate THEN 'warn' ELSE 'pass' END",
    "vbv": "CASE WHEN rc_mode IS NULL THEN NULL WHEN maxrate * bufsize > 0 THEN 'pass' ELSE 'warn' END",
    "scenecut": "CASE WHEN scenecut = 0 THEN 'pass' WHEN scenecut > 0 THEN 'info' END",
    "bits-per-pixel": "CASE WHEN bpp = 0 THEN NULL WHEN bpp >= 0.03 OR family = 'hevc' AND bpp >= 0.02 THEN 'info' WHEN coalesce(rc_mode, '') = 'crf' OR coalesce(rc_mode, '') = 'capped-crf' AND (maxrate = 0 OR avg_rate < maxrate * 1000 * 0.8) THEN 'info' ELSE 'warn' END",
    "colour-signalled": "CASE WHEN has_sps THEN CASE WHEN primaries IS NULL OR 2 IN (primaries, transfer, matrix) THEN 'fail' ELSE 'pass' END END",
    "hdr-consistent": "CASE WHEN transfer = 16 OR transfer = 18 THEN CASE WHEN primaries <> 9 OR matrix < 9 OR coalesce(depth, 8) < 10 THEN 'fail' ELSE 'info' END END",
    "colour-consistent": "CASE WHEN transfer NOT IN (16, 18) AND primaries <> 2 AND matrix <> 2 THEN CASE WHEN (primaries = 9 AND matrix >= 9) OR (primaries <> 9 AND matrix < 9) THEN 'pass' ELSE 'fail' END END",
    "colour-expected": "CASE WHEN primaries IS NOT NULL THEN CASE WHEN primaries = 1 AND matrix = 9 THEN 'pass' ELSE 'fail' END END",
    "range": "CASE WHEN full_range THEN 'warn' WHEN NOT full_range THEN 'pass' END",
    "depth": "CASE WHEN family = 'avc' THEN CASE WHEN depth > 8 THEN 'fail' WHEN depth > 0 THEN 'pass' END END",
    "brands": "CASE WHEN NOT is_mp4 OR brand_list IS NULL THEN NULL WHEN contains(brand_list, 'cmf') AND NOT fragmented THEN 'fail' WHEN brand_list = 'abcd' THEN 'warn' ELSE 'info' END",
    "display-aspect": "CASE WHEN abs(display_width::DOUBLE / display_height / aspect - 1) < 0.02 OR abs(display_height::DOUBLE / display_width / aspect - 1) < 0.02 THEN 'pass' ELSE 'warn' END",
    "hdr-metadata": "CASE WHEN transfer = 16 AND has_entry_boxes THEN CASE WHEN has_mdcv AND has_clli THEN 'pass' ELSE 'warn' END END",
    "fragments": "CASE WHEN moofs = 0 THEN NULL WHEN fragment_problems > 0 THEN 'fail' ELSE 'pass' END",
    "vbv-holds": "CASE WHEN maxrate = 0 OR bufsize = 0 OR frames <= 1 THEN NULL WHEN underflows > 0 THEN 'fail' ELSE 'pass' END",
    "audio-codec": "CASE WHEN audios = 0 THEN NULL WHEN coalesce(audio_codec, '') <> 'AAC LC' THEN 'fail' ELSE 'pass' END",
    "audio-rate": "CASE WHEN sample_rate = 44100 OR sample_rate = 48000 THEN 'pass' WHEN sample_rate > 0 THEN 'warn' END",
    "audio-channels": "CASE WHEN channels = 0 THEN NULL WHEN channels > 2 THEN 'fail' WHEN channels = 2 THEN 'warn' ELSE 'pass' END",
    "audio-bitrate": "CASE WHEN audio_bitrate = 0 OR channels = 0 THEN NULL WHEN audio_bitrate < 48000 * channels THEN 'warn' ELSE 'pass' END",
    "audio-priming": "CASE WHEN audios = 0 OR format = 'mpegts' OR NOT contains(coalesce(audio_codec, ''), 'AAC') THEN NULL WHEN priming_ms > 0 THEN 'pass' ELSE 'warn' END",
    "loudness": "CASE WHEN loudness IS NULL THEN CASE WHEN audios > 0 THEN 'skip' END WHEN loudness BETWEEN -20 AND -16 THEN 'pass' ELSE 'fail' END",
    "true-peak": "CASE WHEN true_peak IS NULL THEN CASE WHEN audios > 0 THEN 'skip' END WHEN true_peak > -1 THEN 'fail' ELSE 'pass' END",
    "av-sync": "CASE WHEN audio_late_ms IS NULL THEN CASE WHEN audios > 0 AND videos > 0 THEN 'skip' END WHEN audio_late_ms BETWEEN -22 AND 22 THEN 'pass' WHEN audio_late_ms BETWEEN -90 AND 185 THEN 'warn' ELSE 'fail' END",
    "quality": "CASE WHEN coalesce(psnr, ssim, vmaf) IS NULL THEN CASE WHEN videos > 0 THEN 'skip' END WHEN coalesce(psnr, 99) < 30 OR coalesce(ssim, 1) < 0.9 OR coalesce(vmaf, 100) < 70 THEN 'warn' ELSE 'info' END",
    "decode-integrity": "CASE WHEN decode_failed THEN 'skip' WHEN decode_errors > 0 THEN 'fail' WHEN decode_errors = 0 THEN 'pass' WHEN videos + audios > 0 THEN 'skip' END",
}

#: Severities by rule, as the register of rules has them.
_OF = {r.id: r.severity for r in audit.ALL_RULES}


def _checks(facts: str, rows: dict[str, str], overlay: dict[str, str] | None = None) -> str:
    over = overlay or {}
    own = " ".join(f"WHEN id = '{k}' THEN '{v}'" for k, v in over.items())
    critical = ", ".join(f"'{k}'" for k in rows if _OF[k] == "critical")
    info = ", ".join(f"'{k}'" for k in rows if _OF[k] == "info")
    return f"""{facts}, every AS ({_cases(rows, 'f')}), checks AS (SELECT *, CASE WHEN level IN ('warn', 'fail') THEN CASE {own} WHEN level = 'fail' AND id IN ({critical or "''"}) THEN 'critical' WHEN id IN ({info or "''"}) THEN 'info' ELSE 'warning' END END AS severity FROM every WHERE level IS NOT NULL)"""


QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


FILE_CHECKS = _checks(f"WITH f AS ({FILE_FACTS})", FILE_SQL, PROFILE["overlay"]["severity"])


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    facts = spark.sql(FILE_FACTS).withColumn("brands", F.split("brand_list", ","))
    facts = audit.with_profile(facts, audit.merged_profile(PROFILE))
    return audit.evaluate(facts, audit.FILE_RULES, PROFILE["overlay"]["severity"])


@query(FILE_CHECKS + " SELECT entity, id, level, severity FROM checks")
def audit_file_rules(spark, sf_dir):
    return file_checks(spark, sf_dir).select("entity", "id", "level", "severity")


LEVEL_COUNTS = ", ".join(f"count(*) FILTER (level = '{k}') AS n_{k}" for k in audit.LEVELS) + ", count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning"


@query(FILE_CHECKS + f" SELECT entity, {LEVEL_COUNTS}, floor(count(*) FILTER (level = 'pass') * 1000 / nullif(count(*) FILTER (level IN ('pass', 'warn', 'fail')), 0))::BIGINT AS compliance FROM checks GROUP BY 1")
def audit_file_tally(spark, sf_dir):
    return audit.tally(file_checks(spark, sf_dir), "entity")


@query(FILE_CHECKS + """ SELECT id, max(level) FILTER (entity = 1) AS "1", max(level) FILTER (entity = 2) AS "2", max(level) FILTER (entity = 3) AS "3",
  min(CASE level WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 WHEN 'pass' THEN 3 ELSE 4 END)::INT AS worst FROM checks WHERE entity <= 3 GROUP BY 1""")
def conformance_matrix(spark, sf_dir):
    return audit.matrix(file_checks(spark, sf_dir).where("entity <= 3"), [1, 2, 3])


@query(FILE_CHECKS + """, found AS (SELECT entity, id, 'fail' AS level, 'critical' AS severity FROM checks WHERE id = 'quality' AND level = 'skip' AND entity % 2 = 0)
SELECT entity, id, level, severity FROM checks WHERE NOT (id = 'quality' AND level = 'skip' AND entity % 2 = 0) UNION ALL SELECT * FROM found""")
def measured_over_skipped(spark, sf_dir):
    checks = file_checks(spark, sf_dir).select("entity", "id", "level", "severity")
    found = checks.where("id = 'quality' and level = 'skip' and entity % 2 = 0").withColumn("level", F.lit("fail")).withColumn("severity", F.lit("critical"))
    return audit.replaced(checks, found)


# ladders: the orders of one customer as renditions of one content

RENDITIONS = """SELECT o_custkey AS ladder, o_orderkey AS file, o_custkey || '-' || (CASE o_orderkey % 4 WHEN 0 THEN '1080p' WHEN 1 THEN '720P' WHEN 2 THEN '360p-240p' ELSE 'plain' END) || '.mp4' AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 640 WHEN 3 THEN 426 ELSE 1900 END AS width, CASE o_orderkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 360 WHEN 3 THEN 240 ELSE 1090 END AS height,
  CASE WHEN o_custkey % 3 = 0 THEN 25 ELSE 25 + o_orderkey % 2 * 25 END AS fps, CAST(floor(o_totalprice) AS BIGINT) AS bitrate, 30 + o_orderkey % 3 * 10 + o_custkey % 2 * 15 AS level, CASE WHEN o_orderkey % 3 < 2 THEN 'avc' ELSE 'hevc' END AS family,
  CASE WHEN o_orderkey % 7 > 0 THEN 'AAC' END AS audio_codec, 48000 AS sample_rate, 2 - CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 2 ELSE 0 END AS channels,
  40000000 + CAST(floor(1000000.0 / CASE WHEN o_custkey % 3 = 0 THEN 25 ELSE 25 + o_orderkey % 2 * 25 END) AS BIGINT) AS fin FROM orders"""
#: Key frames by rendition, in microseconds: every two seconds, some of them moved or left out.
KEYS = """SELECT o_custkey AS ladder, o_orderkey AS file, k * 2000000 + CASE WHEN o_custkey % 3 = 1 AND o_orderkey % 5 = 0 THEN k % 4 * 30000 ELSE 0 END AS t FROM orders CROSS JOIN ({numbers}) n
  WHERE NOT (o_custkey % 5 = 2 AND k % 7 = 3) AND NOT (o_custkey % 7 = 3 AND o_orderkey % 2 = 0 AND k = 9)"""
LADDER_HEAD = f"""WITH RECURSIVE rend AS ({RENDITIONS}), keys AS ({KEYS.format(numbers='SELECT unnest(range(20)) AS k')}),
tol AS (SELECT ladder, floor(500000.0 / min(fps) + 1000)::BIGINT AS tol, count(*) AS n, max(fin) AS fin FROM rend GROUP BY 1),
un AS (SELECT a.ladder, a.file, a.t FROM keys a JOIN tol USING (ladder) JOIN rend r ON r.ladder = a.ladder AND r.file <> a.file
  WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE b.ladder = r.ladder AND b.file = r.file AND b.t BETWEEN a.t - tol.tol AND a.t + tol.tol)),
unmatched AS (SELECT ladder, count(DISTINCT (file, t)) AS n FROM un GROUP BY 1),
k AS (SELECT keys.ladder, file, t, row_number() OVER (PARTITION BY keys.ladder, file ORDER BY t) AS i, t - min(t) OVER (PARTITION BY keys.ladder, file) AS d, tol FROM keys JOIN tol USING (ladder)),
cut(ladder, file, len, j, i, t) AS (
  SELECT k.ladder, file, len, 0::BIGINT, i, t FROM k, (SELECT unnest([2, 4, 5, 6, 10]) * 1000000 AS len) WHERE i = 1
  UNION ALL SELECT c.ladder, c.file, c.len, c.j + 1, n.i, n.t FROM cut c JOIN LATERAL (SELECT i, t FROM k WHERE k.ladder = c.ladder AND k.file = c.file AND k.i > c.i AND k.d >= (c.j + 1) * c.len - k.tol ORDER BY i LIMIT 1) n ON true),
ref AS (SELECT ladder, min(file) AS file FROM rend GROUP BY 1),
counts AS (SELECT ladder, file, len, count(*) AS cuts FROM cut GROUP BY 1, 2, 3),
off AS (SELECT a.ladder, a.len, count(*) FILTER (b.t IS NULL OR abs(a.t - b.t) > tol.tol) AS off FROM cut a JOIN ref USING (ladder) JOIN tol USING (ladder) LEFT JOIN cut b ON b.ladder = a.ladder AND b.file = ref.file AND b.len = a.len AND b.j = a.j GROUP BY 1, 2),
uneven AS (SELECT ladder, len, count(DISTINCT cuts) > 1 AS uneven FROM counts GROUP BY 1, 2),
long AS (SELECT c.ladder, c.len, count(*) FILTER (coalesce(n.t, tol.fin) - c.t > c.len + greatest(tol.tol, c.len // 100)) AS long FROM cut c JOIN ref r ON r.ladder = c.ladder AND r.file = c.file JOIN tol ON tol.ladder = c.ladder
  LEFT JOIN cut n ON n.ladder = c.ladder AND n.file = c.file AND n.len = c.len AND n.j = c.j + 1 GROUP BY 1, 2),
plan AS (SELECT ladder, count(*) FILTER (off = 0 AND NOT uneven AND long = 0) AS fit, count(*) FILTER (off = 0 AND NOT uneven) AS aligned FROM off JOIN uneven USING (ladder, len) JOIN long USING (ladder, len) GROUP BY 1),
steps AS (SELECT ladder, lag(bitrate) OVER (PARTITION BY ladder ORDER BY height DESC, bitrate DESC, file)::DOUBLE / bitrate AS step FROM rend WHERE bitrate > 0),
st AS (SELECT ladder, count(*) AS rated, count(*) FILTER (step < 1) AS up, count(*) FILTER (round(step, 2) < 1.4 OR round(step, 2) > 2.6) AS odd FROM steps GROUP BY 1),
tiers AS (SELECT unnest([144, 240, 360, 480, 540, 720, 1080, 1440, 2160, 4320]) AS tier),
lab AS (SELECT ladder, file, width, height, CASE WHEN name LIKE '%1080p%' THEN 1080 WHEN name LIKE '%720P%' THEN 720 WHEN name LIKE '%-240p%' THEN 240 END AS label FROM rend),
mis AS (SELECT ladder, count(label) AS labelled, count(*) FILTER (label IS NOT NULL AND (least(width, height) > label + 1 OR EXISTS (SELECT 1 FROM (SELECT max(tier) AS b FROM tiers WHERE tier < label) WHERE greatest(width, height) <= floor(b * 16 / 9.0 / 2 + 0.5) * 2 + 2 AND least(width, height) <= b))) AS off FROM lab GROUP BY 1),
f AS (SELECT r.ladder AS entity, count(*) AS n, count(DISTINCT fps) AS rates, count(audio_codec) AS sound, count(DISTINCT coalesce(audio_codec || channels, 'none')) AS sounds, count(*) FILTER (family = 'avc') AS avc, count(*) FILTER (family = 'avc' AND level <= 41) AS low,
  any_value(coalesce(u.n, 0)) AS un, any_value(p.fit) AS fit, any_value(p.aligned) AS aligned, any_value(st.rated) AS rated, any_value(st.up) AS up, any_value(st.odd) AS odd, any_value(mis.labelled) AS labelled, any_value(mis.off) AS off
  FROM rend r LEFT JOIN unmatched u USING (ladder) LEFT JOIN plan p USING (ladder) LEFT JOIN st USING (ladder) LEFT JOIN mis USING (ladder) GROUP BY 1)"""
LADDER_SQL = {
    "idr-aligned": "CASE WHEN n >= 2 THEN CASE WHEN un > 0 THEN 'fail' ELSE 'pass' END END",
    "segment-lengths": "CASE WHEN n >= 2 THEN CASE WHEN fit > 0 THEN 'pass' WHEN aligned > 0 THEN 'warn' ELSE 'fail' END END",
    "frame-rates": "CASE WHEN n >= 2 THEN CASE WHEN rates = 1 THEN 'pass' ELSE 'info' END END",
    "same-audio": "CASE WHEN sound > 0 THEN CASE WHEN sounds = 1 THEN 'pass' ELSE 'warn' END END",
    "bitrate-steps": "CASE WHEN rated >= 2 THEN CASE WHEN up > 0 THEN 'fail' WHEN odd > 0 THEN 'info' ELSE 'pass' END END",
    "label-matches-size": "CASE WHEN labelled > 0 THEN CASE WHEN off > 0 THEN 'warn' ELSE 'pass' END END",
    "levels": "CASE WHEN avc > 0 AND low = 0 THEN 'warn' ELSE 'info' END",
}


def ladder_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(RENDITIONS), spark.sql(KEYS.format(numbers="SELECT id AS k FROM range(20)"))


@query(_checks(LADDER_HEAD, LADDER_SQL) + " SELECT entity, id, level, severity FROM checks")
def audit_ladder_rules(spark, sf_dir):
    facts = ladder.facts(*ladder_tables(spark, sf_dir), audit.SEGMENTS)
    return audit.evaluate(facts, audit.LADDER_RULES).select("entity", "id", "level", "severity")


# presentations: an order as one, its lines as the media playlists of its variants

#: Lines whose order and number are unique.
LINES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nth FROM lineitem) WHERE nth = 1"
PLAYLISTS = """SELECT l_orderkey AS presentation, l_linenumber AS playlist, CASE WHEN l_linenumber = 7 THEN 'iframe' WHEN l_linenumber = 6 THEN 'rendition' ELSE 'variant' END AS role, l_linenumber AS variant, CASE WHEN l_linenumber = 6 THEN 'aud' END AS audio_group,
  CASE WHEN l_orderkey % 9 = 4 THEN 6 + l_linenumber % 2 ELSE 6 - l_orderkey % 3 % 2 END AS target, CASE WHEN l_orderkey % 4 > 0 THEN 'VOD' END AS type, l_orderkey % 5 > 0 AS end_list, 3 + l_orderkey % 4 AS version, 3 + l_partkey % 4 AS needs_version,
  l_suppkey % 10 = 0 AS program_id, l_suppkey % 9 = 0 AS allow_cache, l_orderkey % 8 = 5 AS sampled, CASE WHEN l_partkey % 50 = 0 THEN 'not found' END AS error FROM lines"""
VARIANTS = """SELECT l_orderkey AS presentation, l_linenumber AS variant, CAST(floor(l_extendedprice) AS BIGINT) + 1 AS bandwidth, CASE WHEN l_partkey % 40 > 0 THEN CAST(floor(l_extendedprice / (1 + l_tax)) AS BIGINT) + 1 END AS average_bandwidth,
  CASE WHEN l_partkey % 30 > 0 THEN 'avc1.64001f,mp4a.40.2' END AS codecs, CASE WHEN l_partkey % 25 > 0 THEN 1280 END AS width, CASE WHEN l_partkey % 25 > 0 THEN 720 END AS height, CASE WHEN l_partkey % 35 > 0 THEN 25.0 + CAST(l_partkey % 2 AS DOUBLE) / 10 END AS frame_rate,
  CASE WHEN l_orderkey % 2 = 0 THEN 'aud' END AS audio_group FROM lines"""
SEGMENTS_OF = """SELECT l_orderkey AS presentation, l_linenumber AS playlist, k AS i, CASE WHEN k = 4 THEN 3.0 ELSE 5.0 + CASE WHEN l_orderkey % 6 = 1 THEN CAST(l_linenumber % 3 AS DOUBLE) / 4 ELSE 0.0 END END AS duration,
  CASE WHEN l_orderkey % 8 = 5 AND k = 2 THEN NULL ELSE CAST(floor(l_extendedprice * (5 + (k + l_linenumber) % 3) / 9) AS BIGINT) END AS size, CASE WHEN l_suppkey % 50 = 7 AND k = 1 THEN 'timeout' END AS error
  FROM lines CROSS JOIN ({numbers}) n WHERE k < 5 - CASE WHEN l_orderkey % 10 = 3 THEN l_linenumber % 2 ELSE 0 END"""
PROBES = """SELECT l_orderkey AS presentation, l_linenumber AS playlist, 0 AS i, CASE WHEN l_linenumber <> 6 THEN CASE WHEN l_suppkey % 20 = 3 THEN 'avc1.64001e' WHEN l_suppkey % 20 = 5 THEN 'avc1.64011f' ELSE 'avc1.64001F' END END AS video_codec, CASE WHEN l_suppkey % 20 = 9 THEN 'mp4a.40.5' ELSE 'mp4a.40.2' END AS audio_codec,
  1280 + l_suppkey % 30 % 2 * 2 AS width, 720 AS height, 25.0 + CAST(l_suppkey % 2 AS DOUBLE) / 2 AS fps, l_partkey % 45 <> 11 AS key_first FROM lines"""
MASTERS = "SELECT o_orderkey AS presentation, o_orderkey % 3 > 0 AS independent, 4 + o_orderkey % 4 AS version, 5 + o_custkey % 2 AS needs_version, o_custkey % 11 = 0 AS program_id, o_custkey % 13 = 0 AS allow_cache, o_orderkey % 7 AS iframe_playlists FROM orders WHERE o_orderkey % 12 <> 6"

DELIVERY_HEAD = f"""WITH lines AS ({LINES}), pl0 AS ({PLAYLISTS}), va AS ({VARIANTS}), sg AS ({SEGMENTS_OF.format(numbers='SELECT unnest(range(5)) AS k')}), pr0 AS ({PROBES}), ma AS ({MASTERS}),
pl AS (SELECT * FROM pl0 WHERE error IS NULL), pr AS (SELECT pr0.* FROM pr0 JOIN pl USING (presentation, playlist)),
runs AS (SELECT a.presentation, a.playlist, a.i AS lo, b.i AS hi, sum(c.size) * 8 / sum(c.duration) AS rate, sum(c.duration) AS secs, count(*) = count(c.size) AS sized
  FROM sg a JOIN sg b ON b.presentation = a.presentation AND b.playlist = a.playlist AND b.i >= a.i JOIN sg c ON c.presentation = a.presentation AND c.playlist = a.playlist AND c.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3, 4),
peak AS (SELECT r.presentation, r.playlist, max(rate) AS peak FROM runs r JOIN pl USING (presentation, playlist) WHERE sized AND secs BETWEEN 0.5 * target - 1e-9 AND 1.5 * target + 1e-9 GROUP BY 1, 2),
av AS (SELECT presentation, playlist, sum(size) * 8 / sum(duration) FILTER (size IS NOT NULL) AS average FROM sg GROUP BY 1, 2),
aud AS (SELECT pl.presentation, max(peak) AS peak FROM pl JOIN peak USING (presentation, playlist) WHERE role = 'rendition' GROUP BY 1),
one AS (SELECT pl.*, v.bandwidth, v.average_bandwidth, v.codecs, v.width AS vw, v.height AS vh, v.frame_rate, peak.peak + CASE WHEN v.audio_group IS NOT NULL THEN coalesce(aud.peak, 0) ELSE 0 END AS peak, average, pr.video_codec, pr.audio_codec, pr.width, pr.height, pr.fps
  FROM pl JOIN va v ON v.presentation = pl.presentation AND v.variant = pl.variant LEFT JOIN peak ON peak.presentation = pl.presentation AND peak.playlist = pl.playlist LEFT JOIN av ON av.presentation = pl.presentation AND av.playlist = pl.playlist
  LEFT JOIN aud ON aud.presentation = pl.presentation LEFT JOIN pr ON pr.presentation = pl.presentation AND pr.playlist = pl.playlist WHERE role = 'variant'),
edge AS (SELECT presentation, playlist, i, sum(duration) OVER (PARTITION BY presentation, playlist ORDER BY i) AS e FROM sg),
vp AS (SELECT presentation, playlist, min(playlist) OVER (PARTITION BY presentation) AS ref FROM pl WHERE role = 'variant'),
ns AS (SELECT presentation, playlist, count(*) AS n, sum(duration) AS d FROM sg GROUP BY 1, 2),
eo AS (SELECT vp.presentation, count(*) FILTER (abs(a.e - b.e) > 0.05) AS off FROM vp JOIN edge a ON a.presentation = vp.presentation AND a.playlist = vp.playlist JOIN edge b ON b.presentation = vp.presentation AND b.playlist = vp.ref AND b.i = a.i GROUP BY 1),
no AS (SELECT vp.presentation, count(*) FILTER (a.n <> b.n) AS off FROM vp JOIN ns a ON a.presentation = vp.presentation AND a.playlist = vp.playlist JOIN ns b ON b.presentation = vp.presentation AND b.playlist = vp.ref GROUP BY 1),
g AS (SELECT presentation, count(*) FILTER (role = 'variant') AS nv, bool_and(type IS NOT DISTINCT FROM 'VOD' OR end_list) FILTER (role = 'variant') AS vod, count(*) FILTER (role <> 'iframe') AS plain, count(DISTINCT target) FILTER (role <> 'iframe') AS targets,
  count(*) FILTER (role <> 'iframe' AND target <> 6) AS not6, count(*) FILTER (end_list) AS ended, count(*) FILTER (end_list AND type IS DISTINCT FROM 'VOD') AS notvod, count(*) AS parsed, count(*) FILTER (version < needs_version OR program_id AND version >= 6 OR allow_cache AND version >= 7) AS vers FROM pl GROUP BY 1),
h AS (SELECT presentation, count(bandwidth) FILTER (peak IS NOT NULL) AS peaked, count(*) FILTER (peak > bandwidth * 1.1 OR NOT sampled AND peak < bandwidth / 1.1) AS peakoff, count(*) FILTER (average_bandwidth IS NULL) AS noavg,
  count(*) FILTER (NOT sampled AND abs(average - average_bandwidth) > average_bandwidth * 0.1) AS avgoff, count(*) FILTER (codecs IS NULL) AS nocodec,
  count(*) FILTER (codecs IS NOT NULL AND (lower(video_codec) = 'avc1.64001e' OR audio_codec = 'mp4a.40.9')) AS other, count(*) FILTER (codecs IS NOT NULL AND (lower(video_codec) = 'avc1.64011f' OR audio_codec = 'mp4a.40.5')) AS close,
  count(video_codec) AS pictures, count(*) FILTER (vw IS NULL AND video_codec IS NOT NULL) AS nores, count(*) FILTER (video_codec IS NOT NULL AND (vw <> width OR vh <> height)) AS resoff, count(*) FILTER (frame_rate IS NULL AND video_codec IS NOT NULL) AS nofps,
  count(*) FILTER (video_codec IS NOT NULL AND abs(fps - frame_rate) / fps > 0.01) AS fpsoff FROM one GROUP BY 1),
s AS (SELECT sg.presentation, count(*) FILTER (sg.error IS NOT NULL) AS serr, count(*) FILTER (floor(duration + 0.5) > target OR duration > target + 0.5) AS long FROM sg JOIN pl USING (presentation, playlist) GROUP BY 1),
dd AS (SELECT presentation, max(d) - min(d) AS spread FROM ns JOIN pl USING (presentation, playlist) WHERE role <> 'iframe' GROUP BY 1),
pp AS (SELECT presentation, count(video_codec) AS probed, count(*) FILTER (video_codec IS NOT NULL AND NOT key_first) AS notkey FROM pr GROUP BY 1),
ee AS (SELECT presentation, count(*) AS n, count(error) AS err FROM pl0 GROUP BY 1),
f AS (SELECT ee.presentation AS entity, ee.n, ee.err, ma.presentation IS NOT NULL AS master, ma.*, g.* EXCLUDE (presentation), h.* EXCLUDE (presentation), s.serr, s.long, dd.spread, pp.probed, pp.notkey, eo.off AS eoff, no.off AS noff
  FROM ee LEFT JOIN ma ON ma.presentation = ee.presentation LEFT JOIN g ON g.presentation = ee.presentation LEFT JOIN h ON h.presentation = ee.presentation LEFT JOIN s ON s.presentation = ee.presentation LEFT JOIN dd ON dd.presentation = ee.presentation
  LEFT JOIN pp ON pp.presentation = ee.presentation LEFT JOIN eo ON eo.presentation = ee.presentation LEFT JOIN no ON no.presentation = ee.presentation)"""
_LIVE = "CASE WHEN vod THEN 'fail' ELSE 'warn' END"
DELIVERY_SQL = {
    "hls-reachable": "CASE WHEN err > 0 OR serr > 0 THEN 'fail' ELSE 'pass' END",
    "hls-bandwidth": f"CASE WHEN master AND peaked > 0 THEN CASE WHEN peakoff = 0 THEN 'pass' ELSE {_LIVE} END END",
    "hls-average-bandwidth": f"CASE WHEN master AND nv > 0 THEN CASE WHEN noavg > 0 THEN 'fail' WHEN avgoff > 0 THEN {_LIVE} ELSE 'pass' END END",
    "hls-codecs": "CASE WHEN master AND nv > 0 THEN CASE WHEN nocodec > 0 OR other > 0 THEN 'fail' WHEN close > 0 THEN 'warn' ELSE 'pass' END END",
    "hls-resolution": "CASE WHEN master AND pictures > 0 THEN CASE WHEN nores > 0 THEN 'fail' WHEN resoff > 0 THEN 'warn' ELSE 'pass' END END",
    "hls-frame-rate": "CASE WHEN master AND pictures > 0 THEN CASE WHEN nofps > 0 THEN 'fail' WHEN fpsoff > 0 THEN 'warn' ELSE 'pass' END END",
    "hls-segment-durations": "CASE WHEN parsed > 0 THEN CASE WHEN long > 0 THEN 'fail' ELSE 'pass' END END",
    "hls-target-duration": "CASE WHEN parsed > 0 THEN CASE WHEN not6 > 0 THEN 'warn' ELSE 'pass' END END",
    "hls-same-target": "CASE WHEN plain >= 2 THEN CASE WHEN targets > 1 THEN 'fail' ELSE 'pass' END END",
    "hls-aligned": "CASE WHEN nv >= 2 THEN CASE WHEN eoff + noff > 0 THEN 'fail' ELSE 'pass' END END",
    "hls-same-duration": "CASE WHEN plain >= 2 THEN CASE WHEN spread > 0.05 THEN 'fail' ELSE 'pass' END END",
    "hls-playlist-type": "CASE WHEN ended > 0 THEN CASE WHEN notvod > 0 THEN 'fail' ELSE 'pass' END END",
    "hls-iframes": "CASE WHEN master THEN CASE WHEN iframe_playlists > 0 THEN 'pass' ELSE 'fail' END END",
    "hls-starts-idr": "CASE WHEN probed > 0 THEN CASE WHEN notkey > 0 THEN 'fail' ELSE 'pass' END END",
    "hls-independent": "CASE WHEN master AND probed > 0 AND notkey = 0 THEN CASE WHEN independent THEN 'pass' ELSE 'warn' END END",
    "hls-version": "CASE WHEN parsed > 0 OR master THEN CASE WHEN coalesce(vers, 0) > 0 OR version < needs_version OR program_id AND version >= 6 OR allow_cache AND version >= 7 THEN 'fail' ELSE 'pass' END END",
}


def presentation(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    for t in ("lineitem", "orders"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    spark.sql(LINES).createOrReplaceTempView("lines")
    numbers = SEGMENTS_OF.format(numbers="SELECT id AS k FROM range(5)")
    return {"playlists": spark.sql(PLAYLISTS), "variants": spark.sql(VARIANTS).withColumn("codecs", F.split("codecs", ",")), "segments": spark.sql(numbers), "probes": spark.sql(PROBES), "masters": spark.sql(MASTERS)}


@query(_checks(DELIVERY_HEAD, DELIVERY_SQL) + " SELECT entity, id, level, severity FROM checks")
def audit_playlist_rules(spark, sf_dir):
    facts = delivery.facts(**presentation(spark, sf_dir))
    return audit.evaluate(facts, audit.PLAYLIST_RULES).select("entity", "id", "level", "severity")
