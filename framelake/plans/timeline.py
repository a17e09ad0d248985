"""The registered queries of the timeline operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..operators import delivery, gops, joins, order, rates, stats
from ..operators.samples import micros, read, samples

DAY = 86_400_000_000
HOUR = 3_600_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = """s AS (
  SELECT track, i, offset_, dts, cto, dts + cto AS pts, duration, size, key, letter FROM (
    SELECT user_id AS track, row_number() OVER w - 1 AS i, sum(floor(value * 100 + 0.5)::BIGINT) OVER w - floor(value * 100 + 0.5)::BIGINT AS offset_,
      epoch_us(ts) AS dts, event_id % 3 * 40000000000 AS cto, coalesce(lead(epoch_us(ts)) OVER w - epoch_us(ts), 0) AS duration,
      floor(value * 100 + 0.5)::BIGINT AS size, event_type = 'signup' AS key, event_type AS letter
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
)"""
R = S + ", r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pts, i) - 1 AS rank FROM s)"
G = R + ", g AS (SELECT *, sum(key::INT) OVER (PARTITION BY track ORDER BY i) AS gop FROM r)"
GS = G + ", gs AS (SELECT track, gop, count(*) AS frames, sum(size) AS bytes, min(i) AS first_i, sum(duration) AS ticks, gop = 0 AS partial FROM g GROUP BY track, gop)"


def query(sql: str, head: str = S, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{head}{sql}" if head else sql
        return f

    return add


# sessions of frames


@query(" SELECT track, gop::BIGINT AS gop, count(*) AS frames, min(i) AS first_i FROM g GROUP BY 1, 2", G)
def gop_sessions(spark, sf_dir):
    return gops.gop_ids(samples(spark, sf_dir)).groupBy("track", "gop").agg(F.count("*").alias("frames"), F.min("i").alias("first_i"))


@query(" SELECT track, gop::BIGINT AS gop, frames, bytes::BIGINT AS bytes, first_i, ticks::BIGINT AS ticks, partial FROM gs", GS)
def gop_stats(spark, sf_dir):
    return gops.gop_stats(samples(spark, sf_dir))


@query(""", f AS (SELECT *, gop < max(gop) OVER (PARTITION BY track) AS whole FROM gs WHERE NOT partial)
SELECT track, count(*) AS gops, min(frames) FILTER (whole) AS min_frames, max(frames) FILTER (whole) AS max_frames, (sum(frames) FILTER (whole))::BIGINT AS sum_frames,
  max(ticks)::BIGINT AS max_ticks, coalesce(min(frames) FILTER (whole) = max(frames) FILTER (whole), false) AS fixed FROM f GROUP BY track""", GS)
def gop_summary(spark, sf_dir):
    return gops.gop_summary(samples(spark, sf_dir))


@query(""", l AS (SELECT track, frames, count(*) AS n FROM gs WHERE NOT partial GROUP BY 1, 2)
SELECT track, frames AS usual, n AS n_usual, (t - n)::BIGINT AS odd FROM (SELECT *, sum(n) OVER (PARTITION BY track) AS t, row_number() OVER (PARTITION BY track ORDER BY n DESC, frames DESC) AS k FROM l) WHERE k = 1""", GS)
def gop_usual_length(spark, sf_dir):
    return gops.usual_gop(samples(spark, sf_dir))


@query(""", a AS (SELECT *, row_number() OVER (PARTITION BY track, gop ORDER BY rank) AS pos FROM g WHERE gop BETWEEN 1 AND 400),
p AS (SELECT track, gop, string_agg(letter[1], '' ORDER BY pos) AS pattern FROM a WHERE pos <= 24 GROUP BY 1, 2),
n AS (SELECT track, pattern, count(*) AS n, min(gop) AS first FROM p GROUP BY 1, 2)
SELECT track, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, first) AS k FROM n) WHERE k = 1""", G)
def gop_pattern(spark, sf_dir):
    return gops.gop_patterns(samples(spark, sf_dir))


@query(""", l AS (SELECT *, first_value(rank) OVER (PARTITION BY track, gop ORDER BY i) AS f FROM g)
SELECT track, gop::BIGINT AS gop, count(*) FILTER (rank < f) AS leading FROM l GROUP BY 1, 2""", G)
def gop_leading(spark, sf_dir):
    return gops.leading_frames(samples(spark, sf_dir))


@query(""", b AS (SELECT *, rank - row_number() OVER (PARTITION BY track ORDER BY rank) AS island FROM r WHERE letter = 'click')
SELECT track, max(n) AS longest, sum(n)::BIGINT AS frames FROM (SELECT track, island, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1""", R)
def max_b_run(spark, sf_dir):
    return gops.longest_run(samples(spark, sf_dir), "click")


@query(" SELECT track, letter, count(*) AS frames, sum(size)::BIGINT AS bytes, min(size) AS least, max(size) AS most FROM s GROUP BY 1, 2")
def frame_types(spark, sf_dir):
    return stats.frame_types(samples(spark, sf_dir))


@query(""", l AS (SELECT *, i < max(i) OVER (PARTITION BY track) AS inner_ FROM s)
SELECT track, count(*) AS frames, sum(size)::BIGINT AS bytes, sum(duration)::BIGINT AS ticks, (count(*) FILTER (key))::BIGINT AS keys,
  coalesce((max(duration) FILTER (inner_)) * 20 > (min(duration) FILTER (inner_)) * 21 + 20, false) AS vfr, bool_and(key) AS all_key,
  round(sum(size) * 8000000.0 / nullif(max(dts + duration) - min(dts), 0), 9)::DOUBLE AS bitrate, round(count(*) * 1000000.0 / nullif(max(dts + duration) - min(dts), 0), 9)::DOUBLE AS fps FROM l GROUP BY track""")
def track_stats(spark, sf_dir):
    out = stats.track_stats(samples(spark, sf_dir))
    return out.withColumn("bitrate", F.round("bitrate", 9)).withColumn("fps", F.round("fps", 9))


# order


@query(" SELECT track, i, rank, rank <> i AS reordered FROM r", R)
def display_order(spark, sf_dir):
    return order.display_order(samples(spark, sf_dir)).select("track", "i", "rank", (F.col("rank") != F.col("i")).alias("reordered"))


@query(" SELECT track, i, step FROM (SELECT track, i, pts - lag(pts) OVER (PARTITION BY track ORDER BY i) AS step FROM s) WHERE step < 0")
def dts_backwards(spark, sf_dir):
    return order.dts_backwards(samples(spark, sf_dir), "pts")


GAPS = """SELECT track, i, gap FROM (SELECT track, i, pts - lag(pts) OVER (PARTITION BY track ORDER BY pts, i) AS gap, count(*) OVER (PARTITION BY track) AS n,
  sum(duration) OVER (PARTITION BY track) AS total FROM s) WHERE n > 2 AND gap > 100000 AND gap * 2 * n > 5 * total"""
LATE = """SELECT track, i, gap FROM (SELECT track, i, dts - lag(dts + duration) OVER (PARTITION BY track ORDER BY i) AS gap FROM s) WHERE i < 20000 AND gap > 35000"""


@query(" " + GAPS)
def pts_gaps(spark, sf_dir):
    return order.pts_gaps(samples(spark, sf_dir))


#: Durations of an hour at most, so that frames can be late.
SHORT = S.replace("s AS (", "s0 AS (", 1) + ", s AS (SELECT * REPLACE (least(duration, 3600000000) AS duration) FROM s0)"


@query(f""" SELECT track, i, 'backwards' AS kind, step AS ticks FROM (SELECT track, i, pts - lag(pts) OVER (PARTITION BY track ORDER BY i) AS step FROM s) WHERE step < 0
UNION ALL SELECT track, i, 'gap', gap FROM ({GAPS}) UNION ALL SELECT track, i, 'late', gap FROM ({LATE})""", SHORT)
def anomaly_timeline(spark, sf_dir):
    return order.anomalies(samples(spark, sf_dir).withColumn("duration", F.least("duration", F.lit(HOUR))))


@query(" " + LATE, SHORT)
def late_frames(spark, sf_dir):
    return order.duration_gaps(samples(spark, sf_dir).withColumn("duration", F.least("duration", F.lit(HOUR))))


@query(""" SELECT track, rank, i FROM (SELECT *, greatest(0, least(15, max(rank) OVER (PARTITION BY track) - 9)) AS lo FROM r) WHERE rank >= lo AND rank < lo + 10""", R)
def frames_around(spark, sf_dir):
    return order.around(samples(spark, sf_dir), 20, 10)


@query(""", w AS (SELECT track, i, dts % 1099511627776 AS w FROM s), u(track, i, u) AS (SELECT track, i, w FROM w WHERE i = 0
  UNION ALL SELECT w.track, w.i, u.u + ((w.w - u.u) % 1099511627776 + 1099511627776 + 549755813888) % 1099511627776 - 549755813888 FROM u JOIN w ON w.track = u.track AND w.i = u.i + 1)
SELECT track, i, u AS unwrapped FROM u""", recursive=True)
def unwrap(spark, sf_dir):
    return order.unwrap(samples(spark, sf_dir).withColumn("w", F.col("dts") % (1 << 40)), "w", 1 << 40).select("track", "i", "unwrapped")


@query(""", a AS (SELECT track, i, pts, row_number() OVER (PARTITION BY track ORDER BY i) AS k FROM s), b AS (SELECT track, pts AS sorted, row_number() OVER (PARTITION BY track ORDER BY pts, i) AS k FROM s)
SELECT track, i, sorted - max(sorted - pts) OVER (PARTITION BY track) AS derived FROM a JOIN b USING (track, k)""")
def derive_dts(spark, sf_dir):
    return order.derive_dts(samples(spark, sf_dir))


@query(""", k AS (SELECT *, lag(offset_ + size) OVER (PARTITION BY track ORDER BY i) AS e FROM s WHERE key),
n AS (SELECT *, sum(CASE WHEN e IS NULL OR offset_ - e > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY i) AS run FROM k)
SELECT track, run::BIGINT AS run, min(offset_)::BIGINT AS lo, max(offset_ + size)::BIGINT AS hi, count(*) AS frames FROM n GROUP BY 1, 2""")
def byte_runs(spark, sf_dir):
    return order.coalesce_runs(samples(spark, sf_dir), 30000)


# rates

SERIES = f""", e AS (SELECT track, arg_min(dts, i) AS lo, arg_max(dts + duration, i) AS hi FROM s GROUP BY 1), span AS (SELECT min(lo) AS start, greatest(1, ceil((max(hi) - min(lo)) / {DAY}.0 - 1e-9))::BIGINT AS n FROM e),
grid AS (SELECT track, unnest(range(n)) AS slice FROM e, span),
got AS (SELECT track, greatest(0, least((dts - start) // {DAY}, n - 1)) AS slice, sum(size) * 8 AS bits FROM s, span GROUP BY 1, 2),
series AS (SELECT track, slice, coalesce(bits, 0)::BIGINT AS bits FROM grid LEFT JOIN got USING (track, slice))"""
STATS = """, q AS (SELECT *, slice < max(slice) OVER (PARTITION BY track) OR max(slice) OVER (PARTITION BY track) = 0 AS inner_ FROM series),
st AS (SELECT track, sum(bits)::BIGINT AS total, avg(bits) AS mean, max(bits) FILTER (inner_) AS peak, stddev_pop(bits) FILTER (inner_) AS sd, avg(bits) FILTER (inner_) AS m FROM q GROUP BY 1),
stats AS (SELECT track, total, round(mean, 4) AS mean, peak, (SELECT min(slice) FROM q WHERE q.track = st.track AND inner_ AND bits = peak) AS peak_at, round(sd / nullif(m, 0), 6) AS cv, round(peak / nullif(round(mean, 4), 0), 6) AS ratio FROM st)"""


@query(SERIES + " SELECT * FROM series")
def bitrate_series(spark, sf_dir):
    return rates.bitrate_series(samples(spark, sf_dir), DAY)


@query(SERIES + " SELECT slice, sum(bits)::BIGINT AS bits FROM series GROUP BY 1")
def bitrate_total(spark, sf_dir):
    return stats.totals(rates.bitrate_series(samples(spark, sf_dir), DAY))


@query(SERIES + STATS + " SELECT track, total, mean, peak, peak_at, cv FROM stats")
def rate_stats(spark, sf_dir):
    return rates.rate_stats(rates.bitrate_series(samples(spark, sf_dir), DAY)).drop("ratio")


@query(SERIES + STATS + ", len AS (SELECT track, (max(dts + duration) - min(dts)) / 1000000.0 AS seconds FROM s GROUP BY 1) SELECT track, CASE WHEN seconds < 200000 THEN 'short' WHEN cv < 0.1 AND ratio < 1.2 THEN 'cbr' WHEN ratio < 1.6 THEN 'capped' ELSE 'vbr' END AS guess FROM stats JOIN len USING (track)")
def rate_control_guess(spark, sf_dir):
    s = samples(spark, sf_dir)
    seconds = s.groupBy("track").agg(((F.max(F.col("dts") + F.col("duration")) - F.min("dts")) / 200_000 * 6 / 1_000_000).alias("seconds"))  # a day and more as six seconds
    return rates.rate_control(rates.rate_stats(rates.bitrate_series(s, DAY)).join(seconds, "track"))


@query(f""", b AS (SELECT *, sum(size * 8) OVER (PARTITION BY track ORDER BY dts RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING) AS b FROM s)
SELECT track, CASE WHEN count(*) > 1 AND max(dts + duration) - min(dts) >= 0.999 * {DAY} THEN max(b) END::BIGINT AS peak_bits FROM b GROUP BY 1""")
def peak_window_rate(spark, sf_dir):
    return rates.peak_window(samples(spark, sf_dir), DAY)


@query(""" SELECT track, max(b)::BIGINT AS most_bits FROM (SELECT track, sum(size * 8) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b FROM s) GROUP BY 1""")
def max_run_bits(spark, sf_dir):
    return rates.run_bits(samples(spark, sf_dir))


@query(""", b AS (SELECT track, i, size * 8000000 AS x, sum(size * 8000000) OVER w AS c, dts - first_value(dts) OVER w AS t FROM s WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT a.track, max(a.c - a.t - (b.c - b.x - b.t))::BIGINT AS buffer FROM b a JOIN b ON a.track = b.track AND b.i <= a.i GROUP BY 1""")
def buffer_needed(spark, sf_dir):
    return rates.buffer_needed(samples(spark, sf_dir), 1)


SIM = """, f AS (SELECT track, i, size * 8000000 AS b, coalesce(dts - lag(dts) OVER (PARTITION BY track ORDER BY i), 0) AS g FROM s),
sim(track, i, level, after_, over_) AS (
  SELECT track, -1::BIGINT, 180000000000::BIGINT, NULL::BIGINT, 0::BIGINT FROM (SELECT DISTINCT track FROM s)
  UNION ALL
  SELECT f.track, f.i, greatest(0, least(200000000000, level + g) - b)::BIGINT, (least(200000000000, level + g) - b)::BIGINT, greatest(0, level + g - 200000000000)::BIGINT FROM sim JOIN f ON f.track = sim.track AND f.i = sim.i + 1)"""


@query(SIM + " SELECT track, count(*) FILTER (after_ < -500000) AS underflows, coalesce(min(i) FILTER (after_ < -500000), -1) AS first_i, least(min(after_), 200000000000) AS least, sum(over_)::BIGINT AS full_ticks FROM sim GROUP BY 1", recursive=True)
def vbv_underflows(spark, sf_dir):
    return rates.vbv(samples(spark, sf_dir), 1, 200_000, chunk=32, fan=4).na.fill(-1, ["first_i"])


@query(SIM + " SELECT track, i FROM sim WHERE after_ < -500000", recursive=True)
def vbv_underflow_frames(spark, sf_dir):
    return rates.vbv_underflow_frames(samples(spark, sf_dir), 1, 200_000, chunk=32, fan=4)


CUTS = f""", k AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS k, dts - t0 AS t FROM (SELECT *, min(dts) OVER (PARTITION BY track) AS t0 FROM s) WHERE key),
cut(track, j, k, t) AS (
  SELECT track, 0::BIGINT, k, t FROM k WHERE k = 0
  UNION ALL
  SELECT c.track, c.j + 1, n.k, n.t FROM cut c JOIN LATERAL (SELECT k, t FROM k WHERE k.track = c.track AND k.k > c.k AND k.t >= (c.j + 1) * {DAY} ORDER BY k.k LIMIT 1) n ON true)"""


@query(CUTS + " SELECT track, j, k, t FROM cut", recursive=True)
def packager_segments(spark, sf_dir):
    return rates.packager_cuts(samples(spark, sf_dir), DAY)


# joins in time


def _probes(spark, sf_dir):
    s = samples(spark, sf_dir)
    probe = s.where("letter = 'click'").select("track", F.col("dts").alias("t"))
    return probe, s.where("letter = 'purchase'").select("track", F.col("dts").alias("t"), F.col("i").alias("frame"), F.col("size").alias("level"))


P = S + ", a AS (SELECT track, dts AS t FROM s WHERE letter = 'click'), b AS (SELECT track, dts AS t, i AS frame, size AS level FROM s WHERE letter = 'purchase')"


@query(""" SELECT a.track, a.t, coalesce(b.frame, f.frame) AS frame, coalesce(b.t, f.t) AS at FROM (SELECT *, t + 60000000 AS late FROM a) a ASOF LEFT JOIN b ON a.track = b.track AND a.late >= b.t
LEFT JOIN (SELECT track, arg_min(frame, t) AS frame, min(t) AS t FROM b GROUP BY 1) f ON f.track = a.track""", P)
def frame_at_time(spark, sf_dir):
    return joins.as_of(*_probes(spark, sf_dir), "frame", slack=60_000_000)


@query(""" SELECT a.track, a.t, CASE WHEN n.t IS NOT NULL AND (p.t IS NULL OR n.t - a.t <= a.t - p.t) THEN n.frame ELSE p.frame END AS frame,
  CASE WHEN n.t IS NOT NULL AND (p.t IS NULL OR n.t - a.t <= a.t - p.t) THEN n.t ELSE p.t END AS at
FROM a ASOF LEFT JOIN b p ON a.track = p.track AND a.t >= p.t ASOF LEFT JOIN b n ON a.track = n.track AND a.t <= n.t""", P)
def nearest_frame(spark, sf_dir):
    return joins.nearest(*_probes(spark, sf_dir), "frame")


@query(""" SELECT a.track, a.t, round(p.level + (n.level - p.level)::DOUBLE / nullif(n.t - p.t, 0) * (a.t - p.t), 3) AS level
FROM a ASOF LEFT JOIN b p ON a.track = p.track AND a.t >= p.t ASOF LEFT JOIN b n ON a.track = n.track AND a.t <= n.t""", P)
def clock_interpolation(spark, sf_dir):
    return joins.interpolate(*_probes(spark, sf_dir), "level")


@query(f""", x AS (SELECT track, i, dts AS lo, dts + duration AS hi, unnest(range(dts // {DAY}, (dts + duration - 1) // {DAY} + 1)) AS cell FROM s WHERE duration > 0)
SELECT track, i, cell, least(hi, (cell + 1) * {DAY}) - greatest(lo, cell * {DAY}) AS ticks FROM x""")
def overlap_runs(spark, sf_dir):
    s = samples(spark, sf_dir)
    return joins.overlap(s.select("track", "i", F.col("dts").alias("lo"), (F.col("dts") + F.col("duration")).alias("hi")), DAY)


KEYS = "keys AS (SELECT DISTINCT event_type AS version, epoch_us(ts) AS t FROM events)"


def _keys(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("version"), micros("ts").alias("t"))


@query(""" SELECT a.version, a.t, count(DISTINCT b.version) AS peers FROM keys a LEFT JOIN keys b ON b.version <> a.version AND b.t BETWEEN a.t - 300000000 AND a.t + 300000000 GROUP BY 1, 2""", KEYS)
def key_alignment(spark, sf_dir):
    return joins.key_alignment(_keys(spark, sf_dir), 300_000_000)


@query(f""", e AS (SELECT version, min(t) AS lo, max(t) AS hi FROM keys GROUP BY 1),
grid AS (SELECT version, unnest(range((lo + {HOUR - 1}) // {HOUR}, hi // {HOUR} + 1)) AS k FROM e),
m AS (SELECT g.version, g.k, count(x.t) AS n FROM grid g LEFT JOIN keys x ON x.version = g.version AND x.t BETWEEN g.k * {HOUR} - 600000000 AND g.k * {HOUR} + 600000000 GROUP BY 1, 2)
SELECT version, count(*) AS bounds, count(*) FILTER (n = 0) AS missing, min(k) FILTER (n = 0) AS first_missing FROM m GROUP BY 1""", KEYS)
def segment_fit(spark, sf_dir):
    return joins.segment_fit(_keys(spark, sf_dir), HOUR, 600_000_000)


@query(""", p AS (SELECT a.version, a.t, count(DISTINCT b.version) AS peers, coalesce(bool_or(b.version = 'click'), false) AS ref FROM keys a LEFT JOIN keys b ON b.version <> a.version AND b.t BETWEEN a.t - 900000000 AND a.t + 900000000 GROUP BY 1, 2), n AS (SELECT count(DISTINCT version) AS n FROM keys)
SELECT version, count(*) AS keys, count(*) FILTER (peers >= n - 1) AS everywhere, CASE WHEN version = 'click' THEN 1000 ELSE count(*) FILTER (ref) * 1000 // count(*) END::BIGINT AS share FROM p, n GROUP BY version""", KEYS)
def aligned_everywhere(spark, sf_dir):
    return joins.aligned_everywhere(_keys(spark, sf_dir), 900_000_000, "click")


@query(f""", e AS (SELECT version, min(t) AS lo, max(t) AS hi FROM keys GROUP BY 1), grid AS (SELECT version, unnest(range((lo + {HOUR - 1}) // {HOUR}, hi // {HOUR} + 1)) AS k FROM e),
m AS (SELECT g.version, g.k, count(x.t) AS n FROM grid g LEFT JOIN keys x ON x.version = g.version AND x.t BETWEEN g.k * {HOUR} - 600000000 AND g.k * {HOUR} + 600000000 GROUP BY 1, 2) SELECT k, count(*) AS versions, count(*) FILTER (n = 0) AS missing FROM m GROUP BY 1 HAVING count(*) FILTER (n = 0) > 0""", KEYS)
def missing_anywhere(spark, sf_dir):
    return joins.missing_anywhere(_keys(spark, sf_dir), HOUR, 600_000_000)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS i, l_quantity AS size FROM lineitem),
a AS (SELECT l_orderkey // 2 AS track, i, size FROM l WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey // 2 AS track, i, size FROM l WHERE l_orderkey % 2 = 1)
SELECT coalesce(a.track, b.track) AS track, CASE WHEN count(a.size) > 0 AND count(b.size) > 0 THEN bool_and(a.size IS NOT DISTINCT FROM b.size) END AS copied
FROM a FULL JOIN b ON a.track = b.track AND a.i = b.i GROUP BY 1""", "")
def copied_track(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 2)).alias("track"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("size"), (F.col("l_orderkey") % 2).alias("side"))
    return joins.same_frames(t.where("side = 0"), t.where("side = 1"))


@query("""SELECT l_suppkey, count(*) AS packets, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM lineitem GROUP BY 1""", "")
def pid_share(spark, sf_dir):
    return stats.shares(read(spark, sf_dir, "lineitem"), "l_suppkey").withColumn("share", F.round("share", 6))


SEG = "seg AS (SELECT l_orderkey AS playlist, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_quantity AS d, CASE WHEN l_partkey % 13 > 0 THEN floor(l_extendedprice * 100 + 0.5)::BIGINT END AS size FROM lineitem)"


def _segments(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("playlist"), F.row_number().over(w).alias("i"), F.col("l_quantity").cast("double").alias("duration"),
        F.when(F.col("l_partkey") % 13 > 0, F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("size"),
    )


@query(""" SELECT playlist, max(rate) AS peak FROM (
  SELECT a.playlist, a.idx, b.idx AS j, round(sum(c.size) * 8 / sum(c.d), 4) AS rate, sum(c.d) AS d, count(*) = count(c.size) AS ok FROM seg a JOIN seg b ON a.playlist = b.playlist AND a.idx <= b.idx
  JOIN seg c ON c.playlist = a.playlist AND c.idx BETWEEN a.idx AND b.idx GROUP BY 1, 2, 3) WHERE ok AND d BETWEEN 25 AND 75 GROUP BY 1""", SEG)
def peak_segment_rate(spark, sf_dir):
    s = _segments(spark, sf_dir)
    targets = s.select("playlist", F.lit(50.0).alias("target")).distinct()
    return delivery.peak_segment_rate(s, targets, ["playlist"]).select("playlist", F.round("peak", 4).alias("peak"))


@query(" SELECT playlist, round(sum(size) * 8 / sum(d) FILTER (size IS NOT NULL), 4) AS average FROM seg GROUP BY 1 HAVING count(size) > 0", SEG)
def average_segment_rate(spark, sf_dir):
    return delivery.average_segment_rate(_segments(spark, sf_dir), ["playlist"]).withColumn("average", F.round("average", 4))


# text and bytes


@query(r"""SELECT page_id, regexp_replace(url, '\?.*', '?…') AS shown FROM pages""", "")
def redact_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.redact(F.col("url")).alias("shown"))


@query("SELECT doc_id, strpos(text, 'the') - 1 AS at FROM documents", "")
def text_find(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (F.instr("text", "the") - 1).cast("long").alias("at"))


@query("""SELECT sizes, count(*) AS n, min(conv_id) AS least FROM (
  SELECT conv_id, sha256(string_agg(length(text)::VARCHAR, ',' ORDER BY turn, role, length(text))) AS sizes FROM conversations GROUP BY 1) GROUP BY 1""", "")
def audio_identity(spark, sf_dir):
    return stats.identities(read(spark, sf_dir, "conversations").withColumn("size", F.length("text")), "conv_id", ["turn", "role"], "size")


@query("SELECT l_orderkey, unnest(range(l_quantity::BIGINT - 25)) AS k, l_linenumber FROM lineitem", "")
def rle_expand(spark, sf_dir):
    return stats.expand_runs(read(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long") - 25).select("l_orderkey", "k", "l_linenumber")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS key FROM orders", "")
def sync_membership(spark, sf_dir):
    listed = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return stats.sync_flags(read(spark, sf_dir, "orders").select("o_orderkey"), listed, "o_orderkey")


@query("""WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b, lead(vec_id) OVER (ORDER BY vec_id) AS n FROM embeddings),
m AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / len(a) AS mse FROM p WHERE n = vec_id + 1)
SELECT vec_id, round(mse, 6) AS mse, round(10 * log10(1 / nullif(mse, 0)), 4) AS psnr FROM m""", "")
def vector_mse_psnr(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    m = e.join(b, "vec_id").select("vec_id", text.mse(F.col("embedding"), F.col("b")).alias("mse"))
    return m.select("vec_id", F.round("mse", 6).alias("mse"), F.round(text.psnr(F.col("mse"), 1.0), 4).alias("psnr"))


@query(""", x AS (SELECT track, i, dts - lag(dts) OVER (PARTITION BY track ORDER BY i) AS d, dts, duration FROM s), y AS (SELECT track, count(*) FILTER (d > 86400000000) AS jumps, sum(duration)::BIGINT AS total, max(dts + duration) - min(dts) AS span FROM x GROUP BY 1) SELECT track, jumps, CASE WHEN jumps > 0 THEN total ELSE span END AS ticks FROM y""")
def jumpy_ticks(spark, sf_dir):
    return stats.jumpy_seconds(samples(spark, sf_dir), 0, DAY)


@query(" SELECT track, median(size)::DOUBLE AS median FROM s GROUP BY 1")
def median_size(spark, sf_dir):
    return stats.median(samples(spark, sf_dir), "track", "size")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)", "")
def undescribed_streams(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return stats.undescribed(read(spark, sf_dir, "lineitem"), known, "l_suppkey")


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > l_tax) AS late FROM lineitem GROUP BY 1", "")
def error_counts(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumns({"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "late": F.col("l_discount") > F.col("l_tax")})
    return stats.error_counts(l, "l_suppkey", ["returned", "open", "late"])


@query("""WITH p AS (SELECT l_suppkey AS bucket, l_returnflag AS category, l_orderkey * 10 + l_linenumber AS o, l_quantity::BIGINT AS bytes FROM lineitem), c AS (SELECT bucket, category, sum(bytes)::BIGINT AS b, min(o) AS o FROM p GROUP BY 1, 2)
SELECT bucket, category, b AS bytes FROM c QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY b DESC, o) = 1""", "")
def dominant_category(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bucket"), F.col("l_returnflag").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), F.col("l_quantity").cast("long").alias("bytes"))
    return stats.dominant(l, ["bucket"])


@query(""", n AS (SELECT track, gop, letter, count(*) AS n, count(*) FILTER (size % 2 = 0) AS s FROM g GROUP BY 1, 2, 3) SELECT track, gop::BIGINT AS gop, string_agg(letter || '=' || n, ',' ORDER BY letter) AS letters, sum(s)::BIGINT AS skippable FROM n GROUP BY 1, 2""", G)
def gop_letters(spark, sf_dir):
    s = gops.gop_ids(samples(spark, sf_dir)).withColumn("skippable", F.col("size") % 2 == 0)
    return stats.gop_letters(s).withColumn("letters", F.expr("array_join(transform(map_entries(letters), e -> concat(e.key, '=', e.value)), ',')"))


@query("""WITH g AS (SELECT l_partkey AS id, min(l_quantity)::DOUBLE / 6 AS gop FROM lineitem GROUP BY 1) SELECT id, CASE WHEN gop = 0 THEN 10 ELSE coalesce((SELECT min(x) FROM (SELECT unnest([2, 4, 5, 6, 10]) AS x) WHERE x >= gop - 0.05), gop) END::DOUBLE AS seconds FROM g""", "")
def packager_lengths(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.min("l_quantity").cast("double") / 6).alias("gop"))
    return g.select("id", stats.segment_length(F.col("gop"), [2, 4, 5, 6, 10]).alias("seconds"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS code, p_size % 3 AS category, p_brand || '/' || p_size % 3 AS name FROM part WHERE p_partkey % 4 > 0 AND p_size % 3 > 0), x AS (SELECT p_partkey AS id, p_brand AS code, p_size % 3 AS category FROM part)
SELECT x.id, coalesce(r.name, (SELECT arg_min(o.name, o.category) FROM r o WHERE o.code = x.code)) AS name FROM x LEFT JOIN r ON r.code = x.code AND r.category = x.category""", "")
def registry_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("code", F.col("p_brand")).withColumn("category", F.col("p_size") % 3)
    registry = p.where("p_partkey % 4 > 0 and category > 0").select("code", "category", F.concat_ws("/", "code", "category").alias("name")).distinct()
    return stats.looked_up(p.select(F.col("p_partkey").alias("id"), "code", "category"), registry, "code", "category").select("id", "name")


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END, c.d, 0)::BIGINT AS duration FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey AS d FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = o_custkey""", "")
def track_defaults(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("track"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).cast("long").alias("duration"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("track"), F.col("c_nationkey").cast("long").alias("duration"))
    return stats.with_defaults(o, c, "track", ["duration"]).select("id", "duration")


@query("SELECT c_custkey AS track FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = 0)", "")
def referenced_tracks(spark, sf_dir):
    refs = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("track"))
    return stats.referenced(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track")), refs, "track")


@query("""WITH n AS (SELECT n_regionkey AS file, n_nationkey + 1000 AS id, [n_regionkey, n_nationkey + 1000] AS path FROM nation UNION ALL SELECT r_regionkey, r_regionkey, [r_regionkey] FROM region UNION ALL SELECT n_regionkey, c_custkey + 2000, [n_regionkey, n_nationkey + 1000, c_custkey + 2000] FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT a.file, a.id, count(b.id) AS n FROM n a LEFT JOIN n b ON b.file = a.file AND b.id <> a.id AND list_contains(b.path, a.id) GROUP BY 1, 2""", "")
def subtree_counts(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("file"), (F.col("n_nationkey") + 1000).cast("long").alias("nation"), F.col("n_nationkey"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("file"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 2000).cast("long").alias("id"), F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    nodes = n.select("file", F.col("nation").alias("id"), F.array("file", "nation").alias("path")).union(r.select("file", F.col("file").alias("id"), F.array("file"))).union(c.select("file", "id", F.array("file", "nation", "id")))
    return stats.subtree_counts(nodes)


@query(""", b AS (SELECT track, gop, bytes, row_number() OVER (PARTITION BY track ORDER BY gop) - 1 AS k FROM gs WHERE NOT partial),
t AS (SELECT *, CASE WHEN k < 2 THEN k - 2.0 ELSE list_sum(list_transform(range(0, 20), lambda i: CASE WHEN (k >> i) % 2 = 1 THEN pow(2.0, -1 - i) ELSE 0.0 END)) END AS turn FROM b), u AS (SELECT *, sum(bytes) OVER (PARTITION BY track ORDER BY turn) AS used FROM t)
SELECT track, gop::BIGINT AS gop FROM u WHERE used <= 300000 OR k = 0""", GS)
def budgeted_gops(spark, sf_dir):
    return stats.budgeted(gops.gop_stats(samples(spark, sf_dir)).where("not partial"), 300_000)
