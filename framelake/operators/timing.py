"""More over ordered tables: clocks and their jumps, delays, interleaving, file order, places in files, and tables side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .samples import UP_TO, by_track

CLOCK = 27_000_000


def _lag(c: str, *by: str, order: str = "i") -> Column:
    return F.lag(c).over(Window.partitionBy(*by).orderBy(order))


# clocks


def clock_intervals(clock: DataFrame, back: int = 0, most: int = 10 * CLOCK) -> DataFrame:
    """``clock`` (track, i, t) with ``step`` to the value before, and ``jump`` where that goes back or too far."""
    c = clock.withColumn("step", F.col("t") - _lag("t", "track"))
    return c.withColumn("jump", F.coalesce((F.col("step") <= back) | (F.col("step") > most), F.lit(False)))


def clock_stats(clock: DataFrame) -> DataFrame:
    """By track the number of values, least, most and mean interval, intervals over 40 and 100 ms, and jumps.

    A jump isn't an interval. Ticks are of a 27 MHz clock.
    """
    c = clock_intervals(clock)
    ok = F.when(~F.col("jump"), F.col("step"))
    return c.groupBy("track").agg(
        F.count("*").alias("n"), F.min(ok).alias("least"), F.max(ok).alias("most"), F.sum(ok).alias("total"), F.count(ok).alias("intervals"),
        F.count(F.when(ok > CLOCK * 40 // 1000, 1)).alias("over_40ms"), F.count(F.when(ok > CLOCK // 10, 1)).alias("over_100ms"), F.count(F.when(F.col("jump"), 1)).alias("jumps"),
    )


def mux_rate(clock: DataFrame, packet_bits: int = 188 * 8, least: int = 8) -> DataFrame:
    """By track the rate between clock values that lie ``least`` packets or more apart: whole, lowest, highest, and
    whether they differ by less than 2 % (A18). ``i`` is the packet's number."""
    c = clock_intervals(clock).withColumn("packets", F.col("i") - _lag("i", "track")).where("not jump and step is not null")
    bits = F.col("packets") * packet_bits
    rate = F.when(F.col("packets") >= least, bits * float(CLOCK) / F.col("step"))
    out = c.groupBy("track").agg(F.try_divide(F.sum(bits) * float(CLOCK), F.sum("step")).alias("rate"), F.min(rate).alias("lowest"), F.max(rate).alias("highest"))
    return out.withColumn("constant", F.col("highest") - F.col("lowest") < 0.02 * F.col("rate"))


def time_jumps(pes: DataFrame, hz: int = 90_000) -> DataFrame:
    """By track the steps of ``dts`` below -0.5 s or above 60 s, and the largest other gap with its place."""
    s = pes.withColumn("step", F.col("dts") - _lag("dts", "track"))
    jump = (F.col("step") * 2 < -hz) | (F.col("step") > 60 * hz)
    gap = F.when(~jump, F.struct("step", (-F.col("i")).alias("at")))
    return s.groupBy("track").agg(F.count(F.when(jump, 1)).alias("jumps"), F.max(gap).alias("g")).select("track", "jumps", F.col("g.step").alias("gap"), (-F.col("g.at")).alias("gap_at"))


def intervals(times: DataFrame) -> DataFrame:
    """By track count, sum, most and where of the steps between known times that don't go back."""
    known = times.where("t is not null").withColumn("step", F.col("t") - _lag("t", "track"))
    ok = F.when(F.col("step") >= 0, F.col("step"))
    most = F.max(F.when(F.col("step") >= 0, F.struct("step", (-F.col("i")).alias("at"))))
    out = known.groupBy("track").agg(F.count(ok).alias("n"), F.sum(ok).alias("total"), most.alias("m"))
    return out.select("track", "n", "total", F.col("m.step").alias("most"), (-F.col("m.at")).alias("at"))


def interpolated_clock(packets: DataFrame, clock: DataFrame) -> DataFrame:
    """``packets`` (track, i) with the time ``t`` in a straight line between the clock values around, none across a jump."""
    c = clock_intervals(clock).select("track", "i", F.struct(F.col("i").alias("at"), F.col("t").alias("v"), "jump").alias("c"), F.lit(0).alias("side"))
    m = packets.select("track", "i", F.lit(None).cast("struct<at:bigint,v:bigint,jump:boolean>").alias("c"), F.lit(1).alias("side")).unionByName(c.withColumn("c", F.col("c").cast("struct<at:bigint,v:bigint,jump:boolean>")))
    w = Window.partitionBy("track").orderBy("i", "side")
    m = m.withColumn("p", F.last("c", ignorenulls=True).over(w.rowsBetween(*UP_TO))).withColumn("n", F.first("c", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("side = 1")
    line = F.col("p.v") + F.try_divide((F.col("n.v") - F.col("p.v")) * (F.col("i") - F.col("p.at")).cast("double"), F.col("n.at") - F.col("p.at"))
    at = F.when(F.col("p.at") == F.col("i"), F.col("p.v").cast("double")).when(F.col("p").isNotNull() & F.col("n").isNotNull() & ~F.col("n.jump"), line)
    return m.select("track", "i", at.alias("t"))


def decoder_delay(pes: DataFrame, modulus: int = 1 << 33) -> DataFrame:
    """By track the least time from arrival to decoding and the number that come too late.

    ``dts`` are ticks that wrap at ``modulus``, ``arrival`` 300ths of them; rows without arrival don't count.
    """
    ticks = modulus * 300
    d = F.pmod(F.col("dts") * 300 - F.col("arrival") + ticks // 2, F.lit(ticks)) - ticks // 2
    return pes.where("arrival is not null and dts is not null").groupBy("track").agg(F.count("*").alias("n"), F.min(d).alias("least"), F.count(F.when(d < 0, 1)).alias("late"))


def continuity(packets: DataFrame, modulus: int = 16) -> DataFrame:
    """By track packets, duplicates and errors of their counters.

    A packet with payload counts one on, one without keeps the counter; one repetition of a packet with payload is a
    duplicate, further ones are errors; after a discontinuity flag anything goes. ``packets``: track, i, counter,
    payload, discontinuity.
    """
    w = by_track("i")
    p = packets.withColumn("b", F.lag("counter").over(w)).withColumn("bp", F.lag("payload").over(w))
    repeats = F.col("payload") & F.col("bp") & (F.col("counter") == F.col("b"))
    p = p.withColumn("rep", F.coalesce(repeats & ~F.col("discontinuity"), F.lit(False)))
    p = p.withColumn("run", F.sum((~F.col("rep")).cast("long")).over(w.rowsBetween(*UP_TO)))
    p = p.withColumn("nth", F.sum(F.col("rep").cast("long")).over(Window.partitionBy("track", "run").orderBy("i").rowsBetween(*UP_TO)))
    expected = F.when(F.col("payload"), F.pmod(F.col("b") + 1, F.lit(modulus))).otherwise(F.col("b"))
    bad = F.col("b").isNotNull() & ~F.col("discontinuity") & F.when(F.col("rep"), F.col("nth") > 1).otherwise(F.col("counter") != expected)
    return p.groupBy("track").agg(F.count("*").alias("packets"), F.count(F.when(F.col("rep") & (F.col("nth") == 1), 1)).alias("duplicates"), F.count(F.when(bad, 1)).alias("errors"))


def changed_sections(sections: DataFrame) -> DataFrame:
    """Sections (track, key, i, version, body) that differ from the one before of the same key, and how (W21b):
    first, version (a new version number), or silent (other bytes under the same number)."""
    w = Window.partitionBy("track", "key").orderBy("i")
    s = sections.withColumn("b", F.lag("body").over(w)).withColumn("v", F.lag("version").over(w)).withColumn("nth", F.row_number().over(w))
    how = F.when(F.col("nth") == 1, "first").when(F.col("version") != F.col("v"), "version").when(F.col("body") != F.col("b"), "silent")
    return s.withColumn("how", how).where("how is not null").select("track", "key", "i", "version", "how")


# decode times and durations


def running_times(durations: DataFrame) -> DataFrame:
    """``durations`` (track, i, duration, base) with ``dts``: the sum of those before since the last row that has a base."""
    d = durations.withColumn("island", F.sum(F.col("base").isNotNull().cast("long")).over(by_track("i").rowsBetween(*UP_TO)))
    w = Window.partitionBy("track", "island").orderBy("i")
    before = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("dts", F.coalesce(F.first("base").over(w.rowsBetween(*UP_TO)), F.lit(0)) + before).drop("island")


def step_durations(samples: DataFrame, first: int = 1000) -> DataFrame:
    """``samples`` with ``duration``, the step to the next dts; the last has the median of the first steps."""
    w = by_track("i")
    s = samples.withColumn("duration", F.lead("dts").over(w) - F.col("dts"))
    middle = F.median(F.when(F.col("i") < first, F.col("duration"))).over(Window.partitionBy("track"))
    return s.withColumn("duration", F.coalesce(F.col("duration").cast("double"), middle, F.lit(0.0)))


def lace_times(frames: DataFrame) -> DataFrame:
    """``frames`` (track, block, lace, laces, t, block_duration, default_duration) with ``pts`` and ``duration`` of each
    frame in its block: the block's share, else the default, else the share of the way to the next block (W24)."""
    blocks = frames.where("lace = 0").select("track", "block", F.lead("t").over(Window.partitionBy("track").orderBy("block")).alias("next"))
    f = frames.join(blocks, ["track", "block"])
    share = F.coalesce(F.col("block_duration") / F.col("laces"), F.col("default_duration").cast("double"), (F.col("next") - F.col("t")) / F.col("laces"), F.lit(0.0))
    return f.withColumn("duration", share).withColumn("pts", F.col("t") + F.col("lace") * share).drop("next")


def carried_pts(frames: DataFrame) -> DataFrame:
    """``frames`` (track, i, pts, duration) where those without a pts go on from the last that has one, rounded."""
    w = by_track("i").rowsBetween(*UP_TO)
    f = frames.withColumn("island", F.sum(F.col("pts").isNotNull().cast("long")).over(w))
    own = Window.partitionBy("track", "island").orderBy("i")
    since = F.coalesce(F.sum("duration").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return f.withColumn("pts", F.floor(F.first("pts").over(own.rowsBetween(*UP_TO)) + since + 0.5).cast("long")).drop("island")


def monotone_times(frames: DataFrame, seconds: Column) -> DataFrame:
    """``frames`` with ``time``: ``seconds``, or the largest before where that is larger; a missing one is the last known
    and a frame of the given ``fps`` for each frame since (P16)."""
    w = by_track("i").rowsBetween(*UP_TO)
    f = frames.withColumn("__s", seconds)
    f = f.withColumn("__k", F.max(F.when(F.col("__s").isNotNull(), F.col("i"))).over(w))
    f = f.withColumn("__s", F.coalesce("__s", F.last("__s", ignorenulls=True).over(w) + (F.col("i") - F.col("__k")) / F.col("fps"), F.col("i") / F.col("fps")))
    return f.withColumn("time", F.max("__s").over(w)).drop("__s", "__k")


def clock_of_blocks(chunks: DataFrame) -> DataFrame:
    """``chunks`` (track, i, size, mode, rate, scale, sample_size, block_align, samples_per_block) with the ``ticks`` before each.

    By mode: ``bytes`` counts bytes in samples of a fixed size, ``blocks`` counts started blocks, ``frames`` counts chunks.
    """
    w = by_track("i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("size") / F.col("block_align"))
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    ticks = F.when(F.col("mode") == "bytes", F.floor(before(F.col("size")) / F.col("sample_size"))).when(F.col("mode") == "blocks", before(blocks) * F.coalesce("samples_per_block", F.lit(1))).otherwise(before(F.lit(1)))
    return chunks.withColumn("ticks", ticks.cast("long"))


# order in the file


def file_order(samples: DataFrame) -> DataFrame:
    """``samples`` of all tracks of a file, in the order in which they lie in it; empty ones are left out."""
    w = Window.partitionBy("file").orderBy("offset", "track", "i")
    return samples.where("size > 0").withColumn("row", (F.row_number().over(w) - 1).cast("long"))


def interleave_drift(samples: DataFrame, tracks: list) -> DataFrame:
    """By file the most that the last times of ``tracks`` are apart in file order, once each has been seen, and where."""
    w = Window.partitionBy("file").orderBy("offset", "track", "i").rowsBetween(*UP_TO)
    s = samples.where("size > 0")
    last = [F.last(F.when(F.col("track") == t, F.col("seconds")), ignorenulls=True).over(w).alias(f"__{k}") for k, t in enumerate(tracks)]
    seen = [F.col(f"__{k}") for k in range(len(tracks))]
    every = seen[0].isNotNull()
    for c in seen[1:]:
        every = every & c.isNotNull()
    s = s.select("file", "offset", *last).where(every)
    drift = F.greatest(*seen) - F.least(*seen)
    return s.groupBy("file").agg(F.max(F.struct(drift.alias("d"), (-F.col("offset")).alias("o"))).alias("x")).select("file", F.col("x.d").alias("drift"), (-F.col("x.o")).alias("offset"))


def fragment_problems(boxes: DataFrame) -> DataFrame:
    """By file the fragments that break the sequence, go back in time on a track, or have no media data after them.

    ``boxes``: file, i, type, sequence, and ``times``, an array of (track, time) of a fragment.
    """
    w = Window.partitionBy("file").orderBy("i")
    b = boxes.withColumn("next", F.lead("type").over(w)).where("type = 'moof'")
    b = b.withColumn("before", F.last("sequence", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = b.select("file", "i", F.explode("times").alias("x")).select("file", "i", "x.track", "x.time")
    t = t.withColumn("back", F.col("time") < F.lag("time").over(Window.partitionBy("file", "track").orderBy("i")))
    back = t.groupBy("file").agg(F.count(F.when(F.col("back"), 1)).alias("backwards"))
    out = b.groupBy("file").agg(F.count("*").alias("fragments"), F.count(F.when(F.col("sequence") != F.col("before") + 1, 1)).alias("breaks"), F.count(F.when(~F.col("next").eqNullSafe(F.lit("mdat")), 1)).alias("unpaired"))
    return out.join(back, "file", "left").na.fill(0, ["backwards"])


def coded_order(frames: DataFrame) -> DataFrame:
    """``frames`` (track, i, sequence, poc) with the ``rank`` in which they are shown."""
    return frames.withColumn("rank", (F.row_number().over(by_track("sequence", "poc", "i")) - 1).cast("long"))


# places


def owner_of_point(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``points`` (file, at) with ``i`` of the frame [offset, offset + size) that holds each, or null.

    Frames don't overlap, so the last one that begins at or before a point is the only one that can hold it.
    """
    a = points.select("file", "at", F.lit(1).alias("side"), F.lit(None).cast("struct<stop:bigint,i:bigint>").alias("f"))
    b = frames.where("size > 0").select("file", F.col("offset").alias("at"), F.lit(0).alias("side"), F.struct((F.col("offset") + F.col("size")).cast("long").alias("stop"), F.col("i").cast("long").alias("i")).alias("f"))
    w = Window.partitionBy("file").orderBy("at", "side").rowsBetween(*UP_TO)
    m = a.unionByName(b).withColumn("f", F.last("f", ignorenulls=True).over(w)).where("side = 1")
    return m.select("file", "at", F.when(F.col("at") < F.col("f.stop"), F.col("f.i")).alias("i"))


def frame_before(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``points`` (file, at) with ``i`` of the last frame that begins at or before each."""
    long = frames.select("file", "offset", F.lit(1 << 62).cast("long").alias("size"), "i")
    return owner_of_point(points, long.withColumn("size", F.col("size") - F.col("offset")))


def deepest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (file, at) with ``id`` of the deepest node [offset, offset + size) around each, or null.

    Nodes nest; on each level they are apart, so it takes one running value by level, not a join of all ranges.
    """
    levels = nodes.select("file", F.lit(0).alias("side"), F.col("offset").alias("at"), "depth", F.struct(F.col("depth").alias("depth"), (F.col("offset") + F.col("size")).alias("stop"), F.col("id").alias("id")).alias("n")).where("n.stop > at")
    depths = nodes.select("file", "depth").distinct()
    probes = points.join(depths, "file").select("file", F.lit(1).alias("side"), "at", "depth", F.lit(None).cast(levels.schema["n"].dataType).alias("n"))
    w = Window.partitionBy("file", "depth").orderBy("at", "side").rowsBetween(*UP_TO)
    m = levels.unionByName(probes).withColumn("n", F.last("n", ignorenulls=True).over(w)).where("side = 1")
    m = m.groupBy("file", "at").agg(F.max(F.when(F.col("at") < F.col("n.stop"), F.struct("n.depth", "n.id"))).alias("x"))
    return points.join(m, ["file", "at"], "left").select("file", "at", F.col("x.id").alias("id"))


def tiling(ranges: DataFrame, owned: DataFrame) -> DataFrame:
    """[lo, hi) of each file cut into runs, each owned by one of the ``owned`` ranges (file, id, offset, size) or by none."""
    inner = owned.join(ranges, "file").select("file", "id", F.greatest("offset", "lo").alias("a"), F.least(F.col("offset") + F.col("size"), F.col("hi")).alias("b"), "hi").where("a < b")
    cuts = ranges.select("file", F.explode(F.array("lo", "hi")).alias("at")).union(inner.select("file", F.explode(F.array("a", "b")).alias("at"))).distinct()
    runs = cuts.withColumn("stop", F.lead("at").over(Window.partitionBy("file").orderBy("at"))).where("stop is not null")
    held = owner_of_point(runs.select("file", "at"), inner.select("file", F.col("a").alias("offset"), (F.col("b") - F.col("a")).alias("size"), F.col("id").alias("i")))
    return runs.join(held, ["file", "at"]).select("file", F.col("at").alias("lo"), F.col("stop").alias("hi"), F.col("i").alias("id"))


def overlapping(frames: DataFrame, lo: int, hi: int) -> DataFrame:
    """Frames that have bytes in [lo, hi), clipped to it."""
    f = frames.where((F.col("offset") < hi) & (F.col("offset") + F.col("size") > lo))
    return f.select("file", "i", F.greatest("offset", F.lit(lo)).alias("a"), F.least(F.col("offset") + F.col("size"), F.lit(hi)).alias("b"))


def data_use(boxes: DataFrame, samples: DataFrame) -> DataFrame:
    """By box (file, box, offset, size) of media data the samples and bytes of each track in it, and the bytes of no track."""
    held = owner_of_point(samples.select("file", F.col("offset").alias("at")), boxes.select("file", "offset", "size", F.col("box").alias("i")))
    s = samples.join(held.select("file", F.col("at").alias("offset"), F.col("i").alias("box")).distinct(), ["file", "offset"]).where("box is not null")
    per = s.groupBy("file", "box", "track").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = per.groupBy("file", "box").agg(F.sort_array(F.collect_list(F.struct("track", "n", "bytes"))).alias("tracks"), F.sum("bytes").alias("used"))
    return boxes.join(whole, ["file", "box"], "left").select("file", "box", "tracks", (F.col("size") - F.coalesce("used", F.lit(0))).alias("unused"))


# tables side by side


def side_by_side(values: DataFrame, props: Sequence[str], reference, near: dict[str, float] | None = None, unknown: set[str] | None = None) -> DataFrame:
    """``values`` (file, prop, text, value) of the properties ``props`` against those of the file ``reference`` (J14):
    file, prop, text, state.

    States: ref, same, changed, lost (missing here), gained (missing there). ``near`` allows a relative difference of
    ``value`` by property; where a property is in ``unknown`` a missing value says nothing, and the state is na.
    """
    near, unknown = near or {}, unknown or set()
    values = values.where(F.col("prop").isin(*props))
    ref = values.where(F.col("file") == reference).select("prop", F.col("text").alias("rt"), F.col("value").alias("rv"))
    grid = values.select("file").distinct().withColumn("prop", F.explode(F.array(*[F.lit(p) for p in props])))
    v = grid.join(values, ["file", "prop"], "left").join(F.broadcast(ref), "prop", "left")  # a row by property at most
    allowed = F.coalesce(*[F.when(F.col("prop") == p, F.lit(t)) for p, t in near.items()], F.lit(None).cast("double"))
    quiet = F.col("prop").isin(*unknown) if unknown else F.lit(False)
    close = F.coalesce((F.col("rv") != 0) & (F.abs(F.col("value") - F.col("rv")) <= allowed * F.abs("rv")), F.lit(False))
    state = (
        F.when(F.col("file") == reference, "ref")
        .when(F.col("text").isNull(), F.when(F.col("rt").isNotNull() & ~quiet, "lost").otherwise("na"))
        .when(F.col("rt").isNull(), F.when(quiet, "na").otherwise("gained"))
        .when((F.col("text") == F.col("rt")) | close, "same")
        .otherwise("changed")
    )
    return v.select("file", "prop", "text", state.alias("state"))


def changes(table: DataFrame, heads: set[str] | None = None) -> DataFrame:
    """Rows of :func:`side_by_side` that tell what changed, of the properties ``heads``."""
    out = table.where("state in ('changed', 'lost', 'gained')")
    return out.where(F.col("prop").isin(*heads)) if heads else out


def index_verdicts(cues: DataFrame, clusters: DataFrame, blocks: DataFrame) -> DataFrame:
    """``cues`` (file, cue, track, time, cluster_at, block_at) with why each fails, or null.

    ``clusters``: file, at; ``blocks``: file, cluster_at, block_at, track, time, key.
    """
    c = clusters.select("file", F.col("at").alias("cluster_at"), F.lit(True).alias("c"))
    b = blocks.select("file", "cluster_at", F.struct("block_at", "track", "time", "key").alias("b"))
    same = F.filter("bs", lambda x: x["track"] == F.col("track"))
    j = cues.join(c, ["file", "cluster_at"], "left").join(b.groupBy("file", "cluster_at").agg(F.collect_list("b").alias("bs")), ["file", "cluster_at"], "left")
    at = F.filter(same, lambda x: F.col("block_at").isNull() | (x["block_at"] == F.col("block_at")))
    now = F.filter(at, lambda x: x["time"] == F.col("time"))
    why = (
        F.when(F.col("cluster_at").isNull(), "no position").when(F.col("c").isNull(), "no cluster there").when(F.coalesce(F.size(same), F.lit(0)) <= 0, "no block of the track")
        .when(F.size(at) == 0, "no block there").when(F.size(now) == 0, "another time").when(~F.exists(now, lambda x: x["key"]), "not a key frame")
    )
    return j.select("file", "cue", why.alias("why"))


def keyframe_index(entries: DataFrame, tags: DataFrame, slack_ms: float = 1.5) -> DataFrame:
    """``entries`` (file, entry, position, ms) of a key frame index with why each fails, or null (J11). ``tags``: file, offset, key, ms."""
    t = tags.select("file", F.col("offset").alias("position"), F.col("key").alias("k"), F.col("ms").alias("at"))
    j = entries.join(t, ["file", "position"], "left")
    why = F.when(F.col("at").isNull(), "no tag there").when(~F.col("k"), "not a key frame").when(F.abs(F.col("ms") - F.col("at")) >= slack_ms, "another time")
    return j.select("file", "entry", why.alias("why"))


def chunk_samples(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks`` (track, chunk from 1, offset) with the number of samples that ``runs`` (track, first_chunk, samples) gives each."""
    r = runs.withColumn("next", F.lead("first_chunk").over(Window.partitionBy("track").orderBy("first_chunk")))
    a = chunks.select("track", F.col("chunk").alias("at"), F.lit(1).alias("side"), "offset", F.lit(None).cast("long").alias("n"))
    b = r.select("track", F.col("first_chunk").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("offset"), F.col("samples").cast("long").alias("n"))
    w = Window.partitionBy("track").orderBy("at", "side").rowsBetween(*UP_TO)
    m = a.unionByName(b).withColumn("n", F.last("n", ignorenulls=True).over(w)).where("side = 1")
    return m.select("track", F.col("at").alias("chunk"), "offset", F.coalesce("n", F.lit(0)).alias("samples"))


def fewest_differences(streams: DataFrame, presets: Sequence[tuple[str, str | None, dict[str, str]]]) -> DataFrame:
    """``streams`` (id, options) with the preset and tune that differ in the fewest options (J25): ten points an option
    and one a tune; the first of ``presets`` (preset, tune, options) wins ties. The presets are literals: no join."""

    def scored(place: int, preset: str, tune: str | None, want: dict[str, str]) -> Column:
        off = [F.when(F.try_element_at("options", F.lit(k)) == v, 0).otherwise(10) for k, v in want.items()]
        total = F.lit(1 if tune else 0)
        for o in off:
            total = total + o
        return F.struct(total.alias("score"), F.lit(place).alias("place"), F.lit(preset).alias("preset"), F.lit(tune).cast("string").alias("tune"))

    best = F.array_min(F.array(*[scored(k, *p) for k, p in enumerate(presets)]))
    return streams.withColumn("b", best).select("id", "b.preset", "b.tune", "b.score")


# choices


def even_sample(rows: DataFrame, most: int, order: str = "i", by: str = "track") -> DataFrame:
    """At most ``most`` rows by group, evenly spread, first and last among them."""
    w = Window.partitionBy(by)
    r = rows.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("__n") - 1) / (most - 1) + 0.5)) if most > 1 else F.array(F.lit(0).cast("long"))
    return r.where((F.col("__n") <= most) | F.array_contains(picks, F.col("__k").cast("long"))).drop("__k", "__n")


def probes(rows: DataFrame, order: str = "i", by: str = "track") -> DataFrame:
    """First, middle and last row by group."""
    w = Window.partitionBy(by)
    r = rows.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    return r.where("__k = 0 or __k = __n - 1 or __k = floor(__n / 2)").drop("__k", "__n")


def first_findings(rows: DataFrame, most: int, order: str = "i", by: str = "track") -> DataFrame:
    """The first ``most`` rows by group (L4)."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__k") <= most).drop("__k")


def byte_runs(samples: DataFrame, threshold: int = 0, most_bytes: int = 4 << 20, most_runs: int = 1000) -> DataFrame:
    """(track, run, lo, hi, frames): bytes to read for ``samples``.

    Samples join where at most a gap of bytes lies between them; the gap is raised until no more than ``most_runs``
    would be left, to the largest that leaves so many. A run ends before it passes ``most_bytes``: runs are
    islands by gap, cut once more where their bytes so far pass a multiple of that size.
    """
    w = by_track("offset", "i")
    s = samples.where("size > 0").withColumn("stop", F.max(F.col("offset") + F.col("size")).over(w.rowsBetween(*UP_TO)))
    s = s.withColumn("gap", F.greatest(F.lit(0), F.col("offset") - F.lag("stop").over(w)))
    kth = s.withColumn("nth", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("gap")))).where(F.col("nth") == most_runs).select("track", F.col("gap").alias("kth"))
    s = s.join(kth, "track", "left").withColumn("limit", F.greatest(F.lit(threshold), F.coalesce("kth", F.lit(0))))
    s = s.withColumn("island", F.sum((F.col("gap").isNull() | (F.col("gap") > F.col("limit"))).cast("long")).over(w.rowsBetween(*UP_TO)))
    inside = Window.partitionBy("track", "island").orderBy("offset", "i")
    s = s.withColumn("part", F.floor((F.col("stop") - F.first("offset").over(inside) - 1) / most_bytes))
    runs = s.groupBy("track", "island", "part").agg(F.min("offset").alias("lo"), F.max("stop").alias("hi"), F.count("*").alias("frames"))
    return runs.select("track", (F.row_number().over(by_track("island", "part")) - 1).cast("long").alias("run"), "lo", "hi", "frames")


def busiest_segment(samples: DataFrame, length: int) -> DataFrame:
    """By track the highest rate of a packager's segments of at least half of ``length`` ticks (microseconds), and where it begins."""
    w = Window.partitionBy("track")
    t = F.col("dts") - F.first("dts").over(by_track("i"))
    s = samples.withColumn("t", t).withColumn("fin", F.max_by(F.col("dts") + F.col("duration"), "i").over(w) - F.first("dts").over(by_track("i"))).withColumn("n", F.count("*").over(w))
    s = s.withColumn("tol", F.floor(F.col("fin") / F.col("n") / 2 + 1000)).withColumn("key", F.coalesce("key", F.lit(True)) | (F.col("i") == 0))
    keys = s.where("key").withColumn("k", (F.row_number().over(by_track("i")) - 1).cast("long"))
    per = keys.withColumn("j", F.floor((F.col("t") + F.col("tol")) / length) + 1).groupBy("track", "j").agg(F.count("*").alias("m"))
    grid = per.groupBy("track").agg(F.max("j").alias("last")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)))
    up_to = by_track("j").rowsBetween(*UP_TO)
    grid = grid.join(per, ["track", "j"], "left").withColumn("f", F.sum(F.coalesce("m", F.lit(0))).over(up_to)).withColumn("k", F.col("j") + F.max(F.col("f") - F.col("j")).over(up_to))
    cuts = grid.join(keys.select("track", "k", F.col("i").alias("ci")), ["track", "k"]).select("track", F.col("ci").alias("i"), F.lit(1).alias("cut"))
    s = s.join(cuts, ["track", "i"], "left").withColumn("segment", F.sum(F.coalesce("cut", F.lit(0))).over(by_track("i").rowsBetween(*UP_TO)))
    seg = s.groupBy("track", "segment").agg(F.min("t").alias("at"), F.sum(F.col("size") * 8).alias("bits"), F.max("fin").alias("fin"))
    seg = seg.withColumn("ticks", F.coalesce(F.lead("at").over(by_track("segment")), F.col("fin")) - F.col("at")).where((F.col("ticks") * 2 >= length) & (F.col("ticks") > 0))
    best = F.max(F.struct((F.col("bits") * 1_000_000.0 / F.col("ticks")).alias("rate"), (-F.col("at")).alias("at")))
    return seg.groupBy("track").agg(best.alias("b")).select("track", F.col("b.rate").alias("rate"), (-F.col("b.at")).alias("at"))


def ladders(files: DataFrame, stem: Column) -> DataFrame:
    """(folder, stem, files): files of one content in one folder, where there are two or more."""
    f = files.withColumn("folder", F.regexp_replace("path", "[^/]*$", "")).withColumn("stem", stem)
    return f.groupBy("folder", "stem").agg(F.sort_array(F.collect_list("path")).alias("files")).where("size(files) > 1")
