"""Queries of clocks, file order, places and tables side by side, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text
from ..operators import levels, timing
from ..operators.samples import micros, read, samples
from .timeline import S

QUERIES, SQL = {}, {}


def query(sql: str, head: str = ""):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, (f"WITH RECURSIVE {head}{sql}" if head else sql)
        return f

    return add


#: Lines of a supplier in a fixed order, as packets or frames: track, i.
L = "l AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i, * FROM lineitem)"


def lines(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("track", F.col("l_suppkey")).withColumn("i", (F.row_number().over(w) - 1).cast("long"))


# clocks: 27 MHz values that mostly go up, with some steps back and some far ahead

C = L + ", c AS (SELECT track, i, i * 900000 + l_partkey % 7 * 300000 + CASE WHEN l_partkey % 41 = 0 THEN 400000000 WHEN l_partkey % 37 = 0 THEN -2000000 ELSE 0 END AS t, l_partkey FROM l)"


def _clock(spark, sf_dir):
    odd = F.when(F.col("l_partkey") % 41 == 0, 400_000_000).when(F.col("l_partkey") % 37 == 0, -2_000_000).otherwise(0)
    return lines(spark, sf_dir).select("track", "i", (F.col("i") * 900_000 + F.col("l_partkey") % 7 * 300_000 + odd).cast("long").alias("t"), "l_partkey")


@query(""", d AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY i) AS d FROM c), e AS (SELECT track, CASE WHEN d > 0 AND d <= 270000000 THEN d END AS ok, d <= 0 OR d > 270000000 AS jump FROM d)
SELECT track, count(*) AS n, min(ok) AS least, max(ok) AS most, sum(ok)::BIGINT AS total, count(ok) AS intervals, count(*) FILTER (ok > 1080000) AS over_40ms, count(*) FILTER (ok > 2700000) AS over_100ms, count(*) FILTER (jump) AS jumps FROM e GROUP BY 1""", C)
def clock_stats(spark, sf_dir):
    return timing.clock_stats(_clock(spark, sf_dir))


@query(""", s AS (SELECT * FROM (SELECT track, i * 5 AS p, t FROM c)), d AS (SELECT track, t - lag(t) OVER w AS d, p - lag(p) OVER w AS p FROM s WINDOW w AS (PARTITION BY track ORDER BY p)), e AS (SELECT track, d, p * 1504 AS bits, CASE WHEN p >= 8 THEN p * 1504 * 27000000.0 / d END AS r FROM d WHERE d > 0 AND d <= 270000000)
SELECT track, round(sum(bits) * 27000000.0 / sum(d), 3)::DOUBLE AS rate, round(min(r), 3)::DOUBLE AS lowest, round(max(r), 3)::DOUBLE AS highest FROM e GROUP BY 1""", C)
def mux_rate(spark, sf_dir):
    out = timing.mux_rate(_clock(spark, sf_dir).withColumn("i", F.col("i") * 5))
    return out.select("track", *[F.round(c, 3).alias(c) for c in ("rate", "lowest", "highest")])


@query(""", d AS (SELECT track, i, t - lag(t) OVER (PARTITION BY track ORDER BY i) AS d FROM c), e AS (SELECT *, d < -45000 OR d > 5400000 AS jump FROM d), g AS (SELECT track, max(d) FILTER (NOT jump) AS gap, count(*) FILTER (jump) AS jumps FROM e GROUP BY 1)
SELECT g.track, jumps, gap, (SELECT min(i) FROM e WHERE e.track = g.track AND NOT jump AND d = gap) AS gap_at FROM g""", C)
def time_jumps(spark, sf_dir):
    return timing.time_jumps(_clock(spark, sf_dir).withColumnRenamed("t", "dts"))


@query(""", k AS (SELECT track, i, t FROM c WHERE i % 3 <> 1), d AS (SELECT track, i, t - lag(t) OVER (PARTITION BY track ORDER BY i) AS d FROM k), g AS (SELECT track, count(*) FILTER (d >= 0) AS n, sum(d) FILTER (d >= 0) AS total, max(d) FILTER (d >= 0) AS most FROM d GROUP BY 1)
SELECT g.track, n, total::BIGINT AS total, most, (SELECT min(i) FROM d WHERE d.track = g.track AND d.d = most) AS at FROM g""", C)
def known_intervals(spark, sf_dir):
    return timing.intervals(_clock(spark, sf_dir).withColumn("t", F.when(F.col("i") % 3 != 1, F.col("t"))))


@query(""", k AS (SELECT track, i, t, t - lag(t) OVER (PARTITION BY track ORDER BY i) AS d FROM c WHERE i % 4 = 0), m AS (SELECT c.track, c.i, p.i AS pi, p.t AS pt, n.i AS ni, n.t AS nt, n.d
  FROM c ASOF LEFT JOIN k p ON p.track = c.track AND p.i <= c.i ASOF LEFT JOIN k n ON n.track = c.track AND n.i > c.i)
SELECT track, i, round(CASE WHEN pi = i THEN pt WHEN d > 0 AND d <= 270000000 THEN pt + (nt - pt) * (i - pi)::DOUBLE / (ni - pi) END, 3)::DOUBLE AS t FROM m""", C)
def clock_between(spark, sf_dir):
    c = _clock(spark, sf_dir)
    return timing.interpolated_clock(c.select("track", "i"), c.where("i % 4 = 0")).select("track", "i", F.round("t", 3).alias("t"))


@query(""", p AS (SELECT track, (t // 300 + 9000) % 8589934592 AS dts, CASE WHEN l_partkey % 5 > 0 THEN t + l_partkey % 11 * 300000 END AS arrival FROM c WHERE t >= 0),
d AS (SELECT track, (dts * 300 - arrival + 1288490188800 + 2576980377600) % 2576980377600 - 1288490188800 AS d FROM p WHERE arrival IS NOT NULL)
SELECT track, count(*) AS n, min(d) AS least, count(*) FILTER (d < 0) AS late FROM d GROUP BY 1""", C)
def decoder_delay(spark, sf_dir):
    c = _clock(spark, sf_dir).where("t >= 0")
    dts = F.pmod(F.floor(F.col("t") / 300) + 9000, F.lit(1 << 33))
    return timing.decoder_delay(c.select("track", dts.alias("dts"), F.when(F.col("l_partkey") % 5 > 0, F.col("t") + F.col("l_partkey") % 11 * 300_000).alias("arrival")))


PK = L + ", p AS (SELECT track, i, (i - i // 9 + CASE WHEN l_partkey % 23 = 0 THEN 3 ELSE 0 END) % 16 AS c, l_partkey % 6 > 0 AS y, l_partkey % 31 = 0 AS x FROM l)"


@query(""", w AS (SELECT *, lag(c) OVER o AS b, lag(y) OVER o AS by_ FROM p WINDOW o AS (PARTITION BY track ORDER BY i)), r AS (SELECT *, b IS NOT NULL AND y AND by_ AND c = b AND NOT x AS rep FROM w),
sim(track, i, n, dup, err) AS (
  SELECT track, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT track FROM r)
  UNION ALL SELECT r.track, r.i, CASE WHEN rep THEN n + 1 ELSE 0 END, dup + CASE WHEN rep AND n = 0 THEN 1 ELSE 0 END, err + CASE WHEN b IS NULL OR x THEN 0 WHEN rep THEN CASE WHEN n > 0 THEN 1 ELSE 0 END WHEN y THEN CASE WHEN c <> (b + 1) % 16 THEN 1 ELSE 0 END ELSE CASE WHEN c <> b THEN 1 ELSE 0 END END
  FROM sim JOIN r ON r.track = sim.track AND r.i = sim.i + 1)
SELECT track, max(i) + 1 AS packets, max(dup) AS duplicates, max(err) AS errors FROM sim GROUP BY 1""", PK)
def packet_continuity(spark, sf_dir):
    l = lines(spark, sf_dir)
    counter = (F.col("i") - F.floor(F.col("i") / 9) + F.when(F.col("l_partkey") % 23 == 0, 3).otherwise(0)) % 16
    return timing.continuity(l.select("track", "i", counter.alias("counter"), (F.col("l_partkey") % 6 > 0).alias("payload"), (F.col("l_partkey") % 31 == 0).alias("discontinuity")))


@query(""", s AS (SELECT track, l_linenumber AS key, i, l_partkey % 3 AS version, md5((l_partkey % 6)::VARCHAR) AS body FROM l), w AS (SELECT *, lag(body) OVER o AS b, lag(version) OVER o AS v, row_number() OVER o AS n FROM s WINDOW o AS (PARTITION BY track, key ORDER BY i))
SELECT track, key, i, version, CASE WHEN n = 1 THEN 'first' WHEN version <> v THEN 'version' ELSE 'silent' END AS how FROM w WHERE n = 1 OR version <> v OR body <> b""", L)
def changed_sections(spark, sf_dir):
    l = lines(spark, sf_dir)
    return timing.changed_sections(l.select("track", F.col("l_linenumber").alias("key"), "i", (F.col("l_partkey") % 3).alias("version"), F.md5((F.col("l_partkey") % 6).cast("string").cast("binary")).alias("body")))


# decode times and durations


@query(""", d AS (SELECT track, i, l_linenumber * 10 AS duration, CASE WHEN l_partkey % 17 = 0 THEN l_orderkey END AS base FROM l),
run(track, i, dts, nxt) AS (SELECT track, i, coalesce(base, 0)::BIGINT, (coalesce(base, 0) + duration)::BIGINT FROM d WHERE i = 0
  UNION ALL SELECT d.track, d.i, coalesce(d.base, r.nxt)::BIGINT, (coalesce(d.base, r.nxt) + d.duration)::BIGINT FROM run r JOIN d ON d.track = r.track AND d.i = r.i + 1) SELECT track, i, dts FROM run""", L)
def running_times(spark, sf_dir):
    l = lines(spark, sf_dir)
    return timing.running_times(l.select("track", "i", (F.col("l_linenumber") * 10).alias("duration"), F.when(F.col("l_partkey") % 17 == 0, F.col("l_orderkey")).alias("base"))).select("track", "i", F.col("dts").cast("long").alias("dts"))


@query(""", d AS (SELECT track, i, lead(dts) OVER (PARTITION BY track ORDER BY i) - dts AS d FROM s), m AS (SELECT track, median(d) FILTER (i < 1000) AS m FROM d GROUP BY 1)
SELECT d.track, i, coalesce(d, m, 0)::DOUBLE AS duration FROM d JOIN m USING (track)""", S)
def step_durations(spark, sf_dir):
    return timing.step_durations(samples(spark, sf_dir).drop("duration")).select("track", "i", "duration")


LACES = L + ", f AS (SELECT track, i // 4 AS block, i % 4 AS lace, count(*) OVER (PARTITION BY track, i // 4) AS laces, i // 4 * 1000 AS t, CASE WHEN i // 4 % 3 = 0 THEN 800 END AS bd, CASE WHEN i // 4 % 3 = 1 THEN 30 END AS dd FROM l)"


@query(""", n AS (SELECT track, block, lead(min(t)) OVER (PARTITION BY track ORDER BY block) AS nxt FROM f GROUP BY 1, 2), o AS (SELECT f.*, coalesce(bd::DOUBLE / laces, dd, (nxt - t)::DOUBLE / laces, 0) AS duration FROM f JOIN n USING (track, block))
SELECT track, block, lace, round(duration, 6)::DOUBLE AS duration, round(t + lace * duration, 6)::DOUBLE AS pts FROM o""", LACES)
def lace_times(spark, sf_dir):
    block = F.floor(F.col("i") / 4)
    f = lines(spark, sf_dir).select("track", block.alias("block"), (F.col("i") % 4).alias("lace"), (block * 1000).alias("t"), F.when(block % 3 == 0, 800).alias("block_duration"), F.when(block % 3 == 1, 30).alias("default_duration"))
    f = f.withColumn("laces", F.count("*").over(Window.partitionBy("track", "block")))
    return timing.lace_times(f).select("track", "block", "lace", F.round("duration", 6).alias("duration"), F.round("pts", 6).alias("pts"))


@query(""", f AS (SELECT track, i, CASE WHEN l_partkey % 5 = 0 OR i = 0 THEN i * 100 END AS pts, 33.25::DOUBLE AS d FROM l), k AS (SELECT track, i, max(i) FILTER (pts IS NOT NULL) OVER (PARTITION BY track ORDER BY i) AS k FROM f)
SELECT track, i, floor(k * 100 + (i - k) * 33.25 + 0.5)::BIGINT AS pts FROM k""", L)
def carried_pts(spark, sf_dir):
    pts = F.when((F.col("l_partkey") % 5 == 0) | (F.col("i") == 0), F.col("i") * 100)
    return timing.carried_pts(lines(spark, sf_dir).select("track", "i", pts.alias("pts"), F.lit(33.25).alias("duration"))).select("track", "i", "pts")


@query(""", f AS (SELECT track, i, CASE WHEN l_partkey % 4 > 0 THEN i * 0.5 + l_partkey % 3 END AS s FROM l), k AS (SELECT *, max(i) FILTER (s IS NOT NULL) OVER (PARTITION BY track ORDER BY i) AS k FROM f),
v AS (SELECT a.track, a.i, coalesce(a.s, b.s + (a.i - b.i) / 2.0, a.i / 2.0) AS s FROM k a LEFT JOIN k b ON b.track = a.track AND b.i = a.k) SELECT track, i, (max(s) OVER (PARTITION BY track ORDER BY i))::DOUBLE AS time FROM v""", L)
def monotone_times(spark, sf_dir):
    f = lines(spark, sf_dir).withColumn("fps", F.lit(2.0))
    return timing.monotone_times(f, F.when(F.col("l_partkey") % 4 > 0, F.col("i") * 0.5 + F.col("l_partkey") % 3)).select("track", "i", "time")


@query(""", c AS (SELECT track, i, l_quantity::BIGINT * 7 AS size, track % 3 AS mode FROM l), b AS (SELECT *, coalesce(sum(size) OVER w, 0) AS bytes, coalesce(sum(ceil(size / 16.0)) OVER w, 0) AS blocks, i AS n FROM c WINDOW w AS (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT track, i, CASE mode WHEN 0 THEN bytes // 4 WHEN 1 THEN blocks * 28 ELSE n END::BIGINT AS ticks FROM b""", L)
def block_clock(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("bytes"), F.lit("blocks"), F.lit("frames")), (F.col("track") % 3 + 1).cast("int"))
    c = lines(spark, sf_dir).select("track", "i", (F.col("l_quantity").cast("long") * 7).alias("size"), mode.alias("mode"), F.lit(4).alias("sample_size"), F.lit(16).alias("block_align"), F.lit(28).alias("samples_per_block"))
    return timing.clock_of_blocks(c).select("track", "i", "ticks")


# order in the file: events of all users of a weekday as one file with a track for each kind

FILES = "f AS (SELECT user_id % 10 AS file, event_type AS track, event_id AS i, event_id * 100 + event_id % 37 AS offset_, floor(value)::BIGINT % 50 AS size, epoch_us(ts) // 1000 AS t FROM events)"


def _files(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).alias("file"), F.col("event_type").alias("track"), F.col("event_id").alias("i"), (F.col("event_id") * 100 + F.col("event_id") % 37).alias("offset"), (F.floor("value") % 50).cast("long").alias("size"), F.floor(micros("ts") / 1000).alias("t"))


@query(" SELECT file, track, i, row_number() OVER (PARTITION BY file ORDER BY offset_, track, i) - 1 AS row FROM f WHERE size > 0", FILES)
def file_order(spark, sf_dir):
    return timing.file_order(_files(spark, sf_dir)).select("file", "track", "i", "row")


@query(""", x AS (SELECT file, offset_, last_value(CASE WHEN track = 'click' THEN t END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN track = 'purchase' THEN t END IGNORE NULLS) OVER w AS b FROM f WHERE size > 0 WINDOW w AS (PARTITION BY file ORDER BY offset_, track, i ROWS UNBOUNDED PRECEDING)),
d AS (SELECT file, offset_, abs(a - b) AS d FROM x WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT file, max(d) AS drift FROM d GROUP BY 1) SELECT m.file, drift, (SELECT min(offset_) FROM d WHERE d.file = m.file AND d.d = drift) AS "offset" FROM m""", FILES)
def interleave_drift(spark, sf_dir):
    return timing.interleave_drift(_files(spark, sf_dir).withColumn("seconds", F.col("t")), ["click", "purchase"])


@query(""", b AS (SELECT track AS file, i, CASE WHEN l_partkey % 9 = 0 THEN 'free' WHEN i % 2 = 0 THEN 'moof' ELSE 'mdat' END AS type, i // 2 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS seq, l_linenumber % 2 AS tr, i * 10 - CASE WHEN l_partkey % 7 = 0 THEN 100 ELSE 0 END AS tm FROM l),
m AS (SELECT *, lead(type) OVER (PARTITION BY file ORDER BY i) AS nxt FROM b), k AS (SELECT *, lag(seq) OVER (PARTITION BY file ORDER BY i) AS before, lag(tm) OVER (PARTITION BY file, tr ORDER BY i) AS tb FROM m WHERE type = 'moof')
SELECT file, count(*) AS fragments, count(*) FILTER (seq <> before + 1) AS breaks, count(*) FILTER (nxt IS DISTINCT FROM 'mdat') AS unpaired, count(*) FILTER (tm < tb) AS backwards FROM k GROUP BY 1""", L)
def fragment_problems(spark, sf_dir):
    kind = F.when(F.col("l_partkey") % 9 == 0, "free").when(F.col("i") % 2 == 0, "moof").otherwise("mdat")
    time = F.col("i") * 10 - F.when(F.col("l_partkey") % 7 == 0, 100).otherwise(0)
    seq = F.floor(F.col("i") / 2) + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)
    b = lines(spark, sf_dir).select(F.col("track").alias("file"), "i", kind.alias("type"), seq.alias("sequence"), F.array(F.struct((F.col("l_linenumber") % 2).alias("track"), time.alias("time"))).alias("times"))
    return timing.fragment_problems(b)


@query(" SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY l_linenumber, l_partkey, i) - 1 AS rank FROM l", L)
def coded_order(spark, sf_dir):
    return timing.coded_order(lines(spark, sf_dir).withColumn("sequence", F.col("l_linenumber")).withColumn("poc", F.col("l_partkey"))).select("track", "i", "rank")


# places


@query(""", p AS (SELECT DISTINCT file, k * 777 AS at FROM f, (SELECT unnest(range(200)) AS k)) SELECT p.file, p.at, g.i FROM p LEFT JOIN f g ON g.file = p.file AND g.offset_ <= p.at AND p.at < g.offset_ + g.size""", FILES)
def owner_of_point(spark, sf_dir):
    f = _files(spark, sf_dir)
    p = f.select("file").distinct().withColumn("at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")), lambda k: k * 777)))
    return timing.owner_of_point(p, f)


@query(""", p AS (SELECT DISTINCT file, k * 5000 + 4000 AS at FROM f, (SELECT unnest(range(50)) AS k)) SELECT p.file, p.at, g.i FROM p ASOF LEFT JOIN f g ON g.file = p.file AND g.offset_ <= p.at""", FILES)
def frame_before(spark, sf_dir):
    f = _files(spark, sf_dir)
    p = f.select("file").distinct().withColumn("at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")), lambda k: k * 5000 + 4000)))
    return timing.frame_before(p, f)


#: Nested ranges: a file, thirds of it, and ninths of every second third.
NODES = "n AS (SELECT file, 1 + d * 100 + k AS id, d AS depth, k * CASE d WHEN 0 THEN 9000 WHEN 1 THEN 3000 ELSE 1000 END AS off, CASE d WHEN 0 THEN 9000 WHEN 1 THEN 2900 ELSE 700 END AS size FROM (SELECT DISTINCT user_id AS file FROM events), (SELECT unnest(range(3)) AS d), (SELECT unnest(range(9)) AS k) WHERE d = 2 AND k // 3 % 2 = file % 2 OR d = 1 AND k < 3 OR d = 0 AND k = 0)"


def _nodes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("file")).distinct()
    n = e.withColumn("d", F.explode(F.array(*map(F.lit, range(3))))).withColumn("k", F.explode(F.array(*map(F.lit, range(9)))))
    n = n.where("d = 2 and floor(k / 3) % 2 = file % 2 or d = 1 and k < 3 or d = 0 and k = 0")
    size = lambda a, b, c: F.element_at(F.array(F.lit(a), F.lit(b), F.lit(c)), F.col("d") + 1).cast("long")
    return n.select("file", (F.col("d") * 100 + F.col("k") + 1).alias("id"), F.col("d").alias("depth"), (F.col("k") * size(9000, 3000, 1000)).alias("offset"), size(9000, 2900, 700).alias("size"))


@query(""", p AS (SELECT DISTINCT file, x * 331 AS at FROM n, (SELECT unnest(range(30)) AS x)) SELECT p.file, p.at, arg_max(n.id, n.depth) AS id FROM p LEFT JOIN n ON n.file = p.file AND n.off <= p.at AND p.at < n.off + n.size GROUP BY 1, 2""", NODES)
def deepest_node(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    p = n.select("file").distinct().withColumn("at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")), lambda k: k * 331)))
    return timing.deepest_node(p, n)


@query(""", o AS (SELECT file, id, greatest(off, 500) AS a, least(off + size, 7000) AS b FROM n WHERE depth = 2), r AS (SELECT * FROM o WHERE a < b), c AS (SELECT file, a AS at FROM r UNION SELECT file, b FROM r UNION SELECT DISTINCT file, 500 FROM n UNION SELECT DISTINCT file, 7000 FROM n),
u AS (SELECT file, c."at" AS lo, lead(c."at") OVER (PARTITION BY file ORDER BY c."at") AS hi FROM c) SELECT u.file, u.lo, u.hi, r.id FROM u LEFT JOIN r ON r.file = u.file AND r.a <= u.lo AND u.lo < r.b WHERE u.hi IS NOT NULL""", NODES)
def tiling_gaps(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    r = n.select("file").distinct().select("file", F.lit(500).cast("long").alias("lo"), F.lit(7000).cast("long").alias("hi"))
    return timing.tiling(r, n.where("depth = 2"))


@query(" SELECT file, i, greatest(offset_, 20000) AS a, least(offset_ + size, 90000) AS b FROM f WHERE offset_ < 90000 AND offset_ + size > 20000", FILES)
def frames_in_range(spark, sf_dir):
    return timing.overlapping(_files(spark, sf_dir), 20000, 90000)


@query(""", b AS (SELECT DISTINCT file, k AS box, k * 100000 AS off, 60000 AS size FROM f, (SELECT unnest(range(4)) AS k)), s AS (SELECT f.file, box, track, count(*) AS n, sum(f.size) AS bytes FROM f JOIN b ON b.file = f.file AND f.offset_ >= b.off AND f.offset_ < b.off + b.size GROUP BY 1, 2, 3)
SELECT b.file, b.box, string_agg(track || ':' || n || ':' || bytes, ',' ORDER BY track) AS tracks, any_value(b.size) - coalesce(sum(bytes), 0)::BIGINT AS unused FROM b LEFT JOIN s ON s.file = b.file AND s.box = b.box GROUP BY 1, 2""", FILES)
def data_use(spark, sf_dir):
    f = _files(spark, sf_dir)
    b = f.select("file").distinct().withColumn("box", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))).withColumn("offset", F.col("box") * 100_000).withColumn("size", F.lit(60_000).cast("long"))
    joined = F.expr("array_join(transform(tracks, t -> concat_ws(':', t.track, t.n, t.bytes)), ',')")
    return timing.data_use(b, f).select("file", "box", joined.alias("tracks"), "unused")


# tables side by side

VALUES = """v AS (SELECT o_custkey AS file, 'priority' AS prop, min(o_orderpriority) AS text, NULL::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'count', count(*)::VARCHAR, count(*) FROM orders GROUP BY 1
  UNION ALL SELECT o_custkey, 'largest', max(floor(o_totalprice))::BIGINT::VARCHAR, max(floor(o_totalprice)) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'open', count(*)::VARCHAR, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
  UNION ALL SELECT o_custkey, 'final', count(*)::VARCHAR, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), first AS (SELECT min(o_custkey) AS f FROM orders)"""


def _values(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("file", F.col("o_custkey"))
    one = lambda df, prop, text_, value: df.groupBy("file").agg(text_.alias("text"), value.cast("double").alias("value")).withColumn("prop", F.lit(prop))
    n, big = F.count("*"), F.max(F.floor("o_totalprice"))
    out = one(o, "priority", F.min("o_orderpriority"), F.max(F.lit(None).cast("double")))
    for df, prop, v in ((o, "count", n), (o, "largest", big), (o.where("o_orderstatus = 'O'"), "open", n), (o.where("o_orderstatus = 'F'"), "final", n)):
        out = out.unionByName(one(df, prop, v.cast("string"), v))
    return out


SIDES = VALUES + """, g AS (SELECT file, prop FROM (SELECT DISTINCT file FROM v), (SELECT DISTINCT prop FROM v)), j AS (SELECT g.file, g.prop, a.text, a.value, b.text AS rt, b.value AS rv, f FROM g CROSS JOIN first LEFT JOIN v a ON a.file = g.file AND a.prop = g.prop LEFT JOIN v b ON b.file = first.f AND b.prop = g.prop),
t AS (SELECT file, prop, text, CASE WHEN file = f THEN 'ref' WHEN text IS NULL THEN CASE WHEN rt IS NULL OR prop = 'final' THEN 'na' ELSE 'lost' END WHEN rt IS NULL THEN CASE WHEN prop = 'final' THEN 'na' ELSE 'gained' END
  WHEN text = rt THEN 'same' WHEN prop = 'largest' AND abs(value - rv) <= 0.1 * rv THEN 'same' ELSE 'changed' END AS state FROM j)"""


def _sides(spark, sf_dir):
    first = read(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("f")).first().f
    return timing.side_by_side(_values(spark, sf_dir), ["priority", "count", "largest", "open", "final"], first, {"largest": 0.1}, {"final"})


@query(" SELECT file, prop, text, state FROM t", SIDES)
def compare_rows(spark, sf_dir):
    return _sides(spark, sf_dir)


@query(" SELECT file, prop, text, state FROM t WHERE state IN ('changed', 'lost', 'gained') AND prop <> 'count'", SIDES)
def compare_changes(spark, sf_dir):
    return timing.changes(_sides(spark, sf_dir), {"priority", "largest", "open", "final"})


CUES = L + """, cl AS (SELECT DISTINCT track AS file, i // 8 * 1000 AS at FROM l), bl AS (SELECT track AS file, i // 8 * 1000 AS cat, i % 8 * 50 AS bat, l_linenumber % 2 AS tr, i * 40 AS tm, l_partkey % 3 > 0 AS key FROM l),
cu AS (SELECT track AS file, i AS cue, l_linenumber % 2 + CASE WHEN l_partkey % 47 = 0 THEN 5 ELSE 0 END AS tr, i * 40 + CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END AS tm, CASE WHEN l_partkey % 43 > 0 THEN i // 8 * 1000 + CASE WHEN l_partkey % 29 = 0 THEN 7 ELSE 0 END END AS cat,
  CASE WHEN l_partkey % 2 = 0 THEN i % 8 * 50 + CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END END AS bat FROM l)"""


@query(""" SELECT cu.file, cue, CASE WHEN cat IS NULL THEN 'no position' WHEN NOT EXISTS (SELECT 1 FROM cl WHERE cl.file = cu.file AND cl.at = cu.cat) THEN 'no cluster there'
  WHEN NOT EXISTS (SELECT 1 FROM bl WHERE bl.file = cu.file AND bl.cat = cu.cat AND bl.tr = cu.tr) THEN 'no block of the track' WHEN NOT EXISTS (SELECT 1 FROM bl WHERE bl.file = cu.file AND bl.cat = cu.cat AND bl.tr = cu.tr AND (cu.bat IS NULL OR cu.bat = bl.bat)) THEN 'no block there'
  WHEN NOT EXISTS (SELECT 1 FROM bl WHERE bl.file = cu.file AND bl.cat = cu.cat AND bl.tr = cu.tr AND (cu.bat IS NULL OR cu.bat = bl.bat) AND bl.tm = cu.tm) THEN 'another time'
  WHEN NOT EXISTS (SELECT 1 FROM bl WHERE bl.file = cu.file AND bl.cat = cu.cat AND bl.tr = cu.tr AND (cu.bat IS NULL OR cu.bat = bl.bat) AND bl.tm = cu.tm AND bl.key) THEN 'not a key frame' END AS why FROM cu""", CUES)
def index_verdicts(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("c", F.floor(F.col("i") / 8) * 1000).withColumn("b", F.col("i") % 8 * 50).withColumn("tr", F.col("l_linenumber") % 2).withColumn("file", F.col("track"))
    odd = lambda k, v: F.when(F.col("l_partkey") % k == 0, v).otherwise(0)
    cues = l.select("file", F.col("i").alias("cue"), (F.col("tr") + odd(47, 5)).alias("track"), (F.col("i") * 40 + odd(19, 1)).alias("time"), F.when(F.col("l_partkey") % 43 > 0, F.col("c") + odd(29, 7)).alias("cluster_at"), F.when(F.col("l_partkey") % 2 == 0, F.col("b") + odd(31, 1)).alias("block_at"))
    blocks = l.select("file", F.col("c").alias("cluster_at"), F.col("b").alias("block_at"), F.col("tr").alias("track"), (F.col("i") * 40).alias("time"), (F.col("l_partkey") % 3 > 0).alias("key"))
    return timing.index_verdicts(cues, l.select("file", F.col("c").alias("at")).distinct(), blocks)


@query(""", t AS (SELECT track AS file, i * 500 AS pos, l_partkey % 4 > 0 AS key, i * 33.0 AS ms FROM l), e AS (SELECT track AS file, i AS entry, i * 500 + CASE WHEN l_partkey % 11 = 0 THEN 3 ELSE 0 END AS pos, i * 33.0 + l_partkey % 3 AS ms FROM l)
SELECT e.file, entry, CASE WHEN t.ms IS NULL THEN 'no tag there' WHEN NOT key THEN 'not a key frame' WHEN abs(e.ms - t.ms) >= 1.5 THEN 'another time' END AS why FROM e LEFT JOIN t ON t.file = e.file AND t.pos = e.pos""", L)
def keyframe_index(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("file", F.col("track"))
    tags = l.select("file", (F.col("i") * 500).alias("offset"), (F.col("l_partkey") % 4 > 0).alias("key"), (F.col("i") * 33.0).alias("ms"))
    e = l.select("file", F.col("i").alias("entry"), (F.col("i") * 500 + F.when(F.col("l_partkey") % 11 == 0, 3).otherwise(0)).alias("position"), (F.col("i") * 33.0 + F.col("l_partkey") % 3).alias("ms"))
    return timing.keyframe_index(e, tags)


@query(""", r AS (SELECT track, i + 1 AS first, l_linenumber AS n FROM l WHERE i % 5 = 0), c AS (SELECT track, i + 1 AS chunk, i * 64 AS "offset" FROM l) SELECT c.track, c.chunk, c."offset", coalesce(r.n, 0) AS samples FROM c ASOF LEFT JOIN r ON r.track = c.track AND r.first <= c.chunk""", L)
def stsc_range_join(spark, sf_dir):
    l = lines(spark, sf_dir)
    runs = l.where("i % 5 = 0").select("track", (F.col("i") + 1).alias("first_chunk"), F.col("l_linenumber").alias("samples"))
    return timing.chunk_samples(runs, l.select("track", (F.col("i") + 1).alias("chunk"), (F.col("i") * 64).alias("offset")))


PRESETS = [("fast", None, {"ref": "1", "me": "0", "sub": "2"}), ("medium", None, {"ref": "3", "me": "1", "sub": "2"}), ("medium", "film", {"ref": "3", "me": "1", "sub": "0"}), ("slow", None, {"ref": "4", "me": "1", "sub": "1"}), ("slow", "grain", {"ref": "4", "me": "2", "sub": "0"})]


@query(f"""WITH s AS (SELECT p_partkey AS id, (p_partkey % 5)::VARCHAR AS ref, (p_partkey % 3)::VARCHAR AS me, (p_size % 3)::VARCHAR AS sub FROM part), p(place, preset, tune, ref, me, sub) AS (VALUES {', '.join(f"({k}, '{a}', {'NULL' if b is None else repr(b)}, '{c['ref']}', '{c['me']}', '{c['sub']}')" for k, (a, b, c) in enumerate(PRESETS))}),
x AS (SELECT id, place, preset, tune, 10 * ((s.ref <> p.ref)::INT + (s.me <> p.me)::INT + (s.sub <> p.sub)::INT) + (tune IS NOT NULL)::INT AS score FROM s, p) SELECT id, preset, tune, score FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY score, place) = 1""")
def preset_argmin(spark, sf_dir):
    text_ = lambda c, n: (F.col(c) % n).cast("string")
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("ref"), text_("p_partkey", 5), F.lit("me"), text_("p_partkey", 3), F.lit("sub"), text_("p_size", 3)).alias("options"))
    return timing.fewest_differences(s, PRESETS)


# choices


@query(""", n AS (SELECT track, i, count(*) OVER (PARTITION BY track) AS n FROM l), k AS (SELECT unnest(range(7)) AS k) SELECT DISTINCT track, i FROM n, k WHERE n <= 7 OR i = floor(k * (n - 1) / 6.0 + 0.5)""", L)
def even_sample(spark, sf_dir):
    return timing.even_sample(lines(spark, sf_dir).select("track", "i"), 7)


@query(""", n AS (SELECT track, i, count(*) OVER (PARTITION BY track) AS n FROM l) SELECT track, i FROM n WHERE i IN (0, n // 2, n - 1)""", L)
def probe_frames(spark, sf_dir):
    return timing.probes(lines(spark, sf_dir).select("track", "i"))


@query(""" SELECT track, i FROM l WHERE l_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY track ORDER BY i) <= 4""", L)
def first_findings(spark, sf_dir):
    return timing.first_findings(lines(spark, sf_dir).where("l_partkey % 3 = 0").select("track", "i"), 4)


RUNS = L + """, f AS (SELECT track, i, l_orderkey * 100 + l_linenumber * 10 AS o, 1 + l_partkey % 9 AS size FROM l), e AS (SELECT *, max(o + size) OVER w AS stop FROM f WINDOW w AS (PARTITION BY track ORDER BY o, i)), g AS (SELECT *, greatest(0, o - lag(stop) OVER (PARTITION BY track ORDER BY o, i)) AS gap FROM e),
k AS (SELECT track, gap AS kth FROM g QUALIFY row_number() OVER (PARTITION BY track ORDER BY gap DESC NULLS LAST) = 20), s AS (SELECT g.*, sum(CASE WHEN gap IS NULL OR gap > greatest(50, coalesce(kth, 0)) THEN 1 ELSE 0 END) OVER (PARTITION BY g.track ORDER BY o, i) AS island FROM g LEFT JOIN k USING (track))"""


@query(""", p AS (SELECT *, (stop - first_value(o) OVER (PARTITION BY track, island ORDER BY o, i) - 1) // 20000 AS part FROM s), r AS (SELECT track, island, part, min(o) AS lo, max(stop) AS hi, count(*) AS frames FROM p GROUP BY 1, 2, 3) SELECT track, row_number() OVER (PARTITION BY track ORDER BY island, part) - 1 AS run, lo, hi, frames FROM r""", RUNS)
def read_runs(spark, sf_dir):
    f = lines(spark, sf_dir).select("track", "i", (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).alias("offset"), (F.col("l_partkey") % 9 + 1).alias("size"))
    return timing.byte_runs(f, 50, 20_000, 20)


DAY = 86_400_000_000


@query(f""", t AS (SELECT track, i, dts - first_value(dts) OVER w AS t, size, key OR i = 0 AS key, last_value(dts + duration) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(dts) OVER w AS fin, count(*) OVER (PARTITION BY track) AS n FROM s WINDOW w AS (PARTITION BY track ORDER BY i)),
k AS (SELECT track, i, t, floor(fin / n / 2 + 1000) AS tol FROM t WHERE key),
cut(track, j, i, t) AS (SELECT track, 0::BIGINT, i, t FROM k WHERE i = 0 UNION ALL SELECT c.track, c.j + 1, x.i, x.t FROM cut c JOIN LATERAL (SELECT i, t FROM k WHERE k.track = c.track AND k.i > c.i AND k.t >= (c.j + 1) * {DAY} - tol ORDER BY k.i LIMIT 1) x ON true),
g AS (SELECT t.track, c.j, c.t AS t0, sum(t.size) * 8 AS bits, any_value(fin) AS fin FROM t ASOF JOIN cut c ON c.track = t.track AND c.i <= t.i GROUP BY 1, 2, 3), r AS (SELECT track, t0, bits, coalesce(lead(t0) OVER (PARTITION BY track ORDER BY j), fin) - t0 AS len FROM g),
q AS (SELECT track, t0, bits * 1000000.0 / len AS rate FROM r WHERE len * 2 >= {DAY} AND len > 0) SELECT track, round(q.rate, 9)::DOUBLE AS rate, t0 AS "at" FROM q QUALIFY row_number() OVER (PARTITION BY track ORDER BY q.rate DESC, t0) = 1""", S)
def segment_peak(spark, sf_dir):
    return timing.busiest_segment(samples(spark, sf_dir), DAY).select("track", F.round("rate", 9).alias("rate"), "at")


@query(r"""WITH f AS (SELECT '/' || c_nationkey || '/' || (CASE c_custkey % 4 WHEN 0 THEN 'clip' WHEN 1 THEN 'Clip_720p' WHEN 2 THEN 'other-' || c_custkey ELSE 'other-final' END) || '.mp4' AS path, c_custkey AS k, c_nationkey AS n FROM customer),
g AS (SELECT path, '/' || n || '/' AS folder, CASE k % 4 WHEN 0 THEN 'clip' WHEN 1 THEN 'clip' ELSE 'other' END AS stem FROM f) SELECT folder, stem, string_agg(path, ',' ORDER BY path) AS files FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def content_stem_groups(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    word = F.when(F.col("c_custkey") % 4 == 0, "clip").when(F.col("c_custkey") % 4 == 1, "Clip_720p").when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("other-"), F.col("c_custkey"))).otherwise("other-final")
    f = c.select(F.concat(F.lit("/"), F.col("c_nationkey"), F.lit("/"), word, F.lit(".mp4")).alias("path"))
    out = timing.ladders(f, text.stem(F.regexp_replace("path", "^.*/", "")))
    return out.select("folder", "stem", F.array_join("files", ",").alias("files"))


# levels: parts as streams, each of the four codecs

ST = "st AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'avc' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' ELSE 'vp9' END AS codec, p_size * 90 AS w, p_size * 50 AS h, 24 + p_partkey % 3 * 18 AS fps, p_retailprice * 20000 AS br, p_partkey % 17 AS dpb, CASE p_partkey % 5 WHEN 0 THEN 66 WHEN 1 THEN 100 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS profile, p_partkey % 6 = 0 AS high, CASE p_partkey % 4 WHEN 0 THEN 31 + p_partkey % 3 WHEN 1 THEN 120 WHEN 2 THEN 8 ELSE 40 END AS idc FROM part)"
_num = lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"
TABLES = ", ".join(f"{c}(k, name, {', '.join(n for n in names.split()[1:])}) AS (VALUES {', '.join('(' + str(k) + ', ' + repr(row[0]) + ', ' + ', '.join(map(_num, row[1:])) + ')' for k, row in enumerate(rows))})" for c, (names, rows) in levels._COLUMNS.items())
LV = ST + ", " + TABLES + """, fit AS (
  SELECT id, k, name, st.idc = l.idc AS own, mb <= size AND greatest(ceil(w / 16.0), ceil(h / 16.0)) <= floor(sqrt(8 * size)) AND mb * fps <= rate AND st.dpb <= least(floor(l.dpb / mb), 16) AND (f IS NULL OR st.br <= l.br * f * (1 + 1e-9)) AS ok
    FROM (SELECT *, ceil(w / 16.0) * ceil(h / 16.0) AS mb, CASE profile WHEN 66 THEN 1200 WHEN 100 THEN 1500 END AS f FROM st WHERE codec = 'avc') st, (SELECT k, name, idc, rate, size, dpb, br FROM avc) l(k, name, idc, rate, size, dpb, br)
  UNION ALL SELECT id, k, name, st.idc = l.idc, ps <= size AND greatest(w, h) <= floor(sqrt(8 * size)) AND ps * fps <= rate AND dpb <= CASE WHEN ps * 4 <= size THEN 16 WHEN ps * 2 <= size THEN 12 WHEN ps * 4 <= size * 3 THEN 8 ELSE 6 END
    AND (profile IS DISTINCT FROM 1 OR CASE WHEN high THEN br_high IS NOT NULL AND br <= br_high * 1100 ELSE br <= br_main * 1100 END) FROM (SELECT *, w * h AS ps FROM st WHERE codec = 'hevc') st, hevc l
  UNION ALL SELECT id, k, name, st.idc = l.idc, w * h <= size AND w <= width AND h <= height AND w * h * fps <= rate AND br <= CASE WHEN high AND br_high IS NOT NULL THEN br_high ELSE br_main END * 1000000 * CASE profile WHEN 1 THEN 2 ELSE 1 END FROM (SELECT * FROM st WHERE codec = 'av1') st, av1 l
  UNION ALL SELECT id, k, name, st.idc = l.idc, w * h <= size AND greatest(w, h) <= side AND w * h * fps <= rate AND st.br <= l.br * 1000 FROM (SELECT * FROM st WHERE codec = 'vp9') st, vp9 l)"""


@query(""" SELECT st.id, max(name) FILTER (own) AS level_name, bool_and(ok) FILTER (own) AS level_fits, arg_min(name, k) FILTER (ok) AS lowest_level FROM st LEFT JOIN fit USING (id) GROUP BY 1""", LV)
def level_check(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    s = p.select(
        k.alias("id"), pick(4, "avc", "hevc", "av1", "vp9").alias("codec"), (F.col("p_size") * 90).alias("width"), (F.col("p_size") * 50).alias("height"), (k % 3 * 18 + 24).alias("fps"), (F.col("p_retailprice") * 20000).alias("bitrate"),
        (k % 17).alias("dpb"), F.when(k % 5 < 4, pick(5, 66, 100, 1, 0, 0)).alias("profile"), (k % 6 == 0).alias("high_tier"), F.when(k % 4 == 0, k % 3 + 31).otherwise(pick(4, 0, 120, 8, 40)).cast("int").alias("level_idc"),
    )
    return levels.check_levels(s).select("id", "level_name", "level_fits", "lowest_level")
