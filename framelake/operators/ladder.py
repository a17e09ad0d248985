"""Renditions of one content side by side: facts for the rules of a ladder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import text
from ..session import ship
from .audit import SIZE_TIERS

#: Key frames and renditions of whole ladders that are compared at once.
CHUNK = 1 << 18


def key_tolerance(fps: Column) -> Column:
    """Half a frame of the slowest rendition and a millisecond, in microseconds; aggregate over renditions."""
    return F.floor(F.coalesce(F.lit(500_000.0) / F.min(F.when(fps > 0, fps)), F.lit(20_000.0)) + 1000).cast("long")


def unmatched_keys(keys: DataFrame, tolerance: DataFrame) -> DataFrame:
    """(ladder, file, t) of key frames that some other rendition has none near.

    ``keys`` (ladder, file, t) meet in buckets as wide as the ladder's ``tolerance`` (ladder, tol, renditions): of each
    rendition and bucket the ends are enough, as a middle bucket lies wholly within the band.
    """
    k = keys.join(tolerance, "ladder").withColumn("own", F.floor(F.col("t") / F.col("tol")))
    ends = k.groupBy("ladder", F.col("file").alias("peer"), F.col("own").alias("bucket")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    probes = k.withColumn("bucket", F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])))
    near = F.expr("bucket = own or bucket < own and t - hi <= tol or bucket > own and lo - t <= tol")
    met = probes.join(ends, ["ladder", "bucket"]).where(near & (F.col("peer") != F.col("file")))
    met = met.groupBy("ladder", "file", "t").agg(F.count_distinct("peer").alias("peers"))
    k = k.select("ladder", "file", "t", "renditions").distinct().join(met, ["ladder", "file", "t"], "left")
    return k.where(F.coalesce("peers", F.lit(0)) < F.col("renditions") - 1).select("ladder", "file", "t")


def cuts(keys: DataFrame, tolerance: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(ladder, file, len, j, t): where a packager cuts each rendition into segments of each length (microseconds).

    The j-th cut is at the first unused key frame that is no earlier than j lengths less the tolerance. With f(i) key
    frames before that point of i, it is key frame j + max over i <= j of f(i) - i, so no key frame is visited in turn.
    """
    own = Window.partitionBy("ladder", "file")
    k = keys.join(tolerance.select("ladder", "tol"), "ladder").withColumn("d", F.col("t") - F.min("t").over(own)).withColumn("k", (F.row_number().over(own.orderBy("t")) - 1).cast("long"))
    per = k.withColumn("len", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths]))).withColumn("j", F.floor((F.col("d") + F.col("tol")) / F.col("len")) + 1)
    n = per.groupBy("ladder", "file", "len", "j").agg(F.count("*").alias("n"))
    grid = n.groupBy("ladder", "file", "len").agg(F.max("j").alias("last")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)))
    up_to = Window.partitionBy("ladder", "file", "len").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.join(n, ["ladder", "file", "len", "j"], "left").withColumn("f", F.sum(F.coalesce("n", F.lit(0))).over(up_to))
    grid = grid.withColumn("k", F.col("j") + F.max(F.col("f") - F.col("j")).over(up_to))
    return grid.join(k.select("ladder", "file", "k", "t"), ["ladder", "file", "k"]).select("ladder", "file", "len", "j", "t")


def segment_plans(renditions: DataFrame, keys: DataFrame, tolerance: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(ladder, len, aligned, segments, long, longest): whether a length cuts all renditions alike, and the segments that run over it."""
    c = cuts(keys, tolerance, lengths)
    first = renditions.groupBy("ladder").agg(F.min("file").alias("file"), F.max("fin").alias("fin")).join(tolerance.select("ladder", "tol"), "ladder")
    ref = c.join(first, ["ladder", "file"]).withColumn("next", F.coalesce(F.lead("t").over(Window.partitionBy("ladder", "len").orderBy("j")), F.col("fin")))
    ref = ref.withColumn("run", F.col("next") - F.col("t"))
    over = F.col("run") > F.col("len") + F.greatest(F.col("tol"), F.floor(F.col("len") / 100))
    long = ref.groupBy("ladder", "len").agg(F.count("*").alias("segments"), F.count(F.when(over, 1)).alias("long"), F.max("run").alias("longest"))
    both = c.join(ref.select("ladder", "len", "j", F.col("t").alias("at"), "tol"), ["ladder", "len", "j"], "left")
    off = F.count(F.when(F.col("at").isNull() | (F.abs(F.col("t") - F.col("at")) > F.col("tol")), 1))
    files = both.groupBy("ladder", "len", "file").agg(F.count("*").alias("n"), off.alias("off"))
    same = files.groupBy("ladder", "len").agg(((F.sum("off") == 0) & (F.min("n") == F.max("n"))).alias("aligned"))
    return same.join(long, ["ladder", "len"])


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from the row before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ladder, file and t: a row by run of one file, with the first time and the steps to the next ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(2).to_numpy(zero_copy_only=False).astype("<i8")
        at = np.flatnonzero(_changes(batch.column(0), batch.column(1)))
        steps = np.diff(t, prepend=t[:1])
        steps[at] = t[at]
        edges = np.append(at, len(t)).astype(np.int32) * 8
        times = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(steps)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), times], names=["ladder", "file", "times"])


def _unmatched(ladder: np.ndarray, file: np.ndarray, t: np.ndarray, tol: np.ndarray, renditions: np.ndarray) -> np.ndarray:
    """By ladder, the key frames (one by file and time) that some other rendition has none near; keys are sorted by file and time.

    The bands around the keys of a file, where they touch, are one interval, so as many intervals as files have a key
    near lie over each point.
    """
    new = np.ones(len(t), bool)
    new[1:] = (file[1:] != file[:-1]) | (t[1:] != t[:-1])
    ladder, file, t = ladder[new], file[new], t[new]
    apart = np.ones(len(t) + 1, bool)
    apart[1:-1] = (file[1:] != file[:-1]) | (t[1:] - t[:-1] > 2 * tol[ladder[1:]])
    first, last = apart[:-1], apart[1:]
    where = np.concatenate([ladder[first], ladder, ladder[last]])
    point = np.concatenate([t[first] - tol[ladder[first]], t, t[last] + tol[ladder[last]]])
    kind = np.repeat([1, 0, -1], [first.sum(), len(t), last.sum()])
    order = np.lexsort((-kind, point, where))
    over, kind, where = np.cumsum(kind[order]), kind[order], where[order]
    return np.bincount(where[(kind == 0) & (over < renditions[where])], minlength=len(tol))


def _cut(file_first: np.ndarray, file: np.ndarray, late: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys that a packager cuts at, the cut's number within its file); ``late`` is a key's time in its file and the tolerance.

    Key k of a file may be cut g = late // length or an earlier one, so up to it there are min(g + 1, one more than up
    to the key before) cuts: k + 1 + the least of 0 and g - i over all keys i up to k.
    """
    i = np.arange(len(late)) - file_first[file]
    least = np.minimum(late // length - i, 0) - file * (len(late) + 1)  # each file's are less than those of the one before
    n = i + 1 + np.minimum.accumulate(least) + file * (len(late) + 1)
    before = np.where(i > 0, np.concatenate([[0], n[:-1]]), 0)
    at = np.flatnonzero(n > before)
    return at, n[at] - 1


def _compare(rows: pa.Table, lengths: Sequence[int]) -> pa.Table:
    """What :func:`compared` gives, from whole ladders sorted by ladder and file: renditions, and keys as packed."""
    columns = [rows.column(n).combine_chunks() for n in ("ladder", "file", "times", "fps", "fin")]
    begins = _changes(columns[0])
    ladder = np.cumsum(begins) - 1
    owner = np.cumsum(_changes(columns[0], columns[1])) - 1
    size, files = int(ladder[-1]) + 1, int(owner[-1]) + 1
    of = np.zeros(files, np.int64)
    of[owner] = ladder
    shown = columns[2].is_null().to_numpy(zero_copy_only=False)  # renditions
    renditions = np.bincount(ladder[shown], minlength=size)

    fps = pc.fill_null(columns[3], 0.0).to_numpy(zero_copy_only=False)
    slowest = np.full(size, np.inf)
    some = shown & (fps > 0)
    np.minimum.at(slowest, ladder[some], fps[some])
    half = np.where(np.isfinite(slowest), 500_000.0 / slowest, 20_000.0)
    tol = np.floor(half + 1000).astype(np.int64)
    ended = shown & columns[4].is_valid().to_numpy(zero_copy_only=False)
    fin = np.full(size, np.iinfo(np.int64).min)
    np.maximum.at(fin, ladder[ended], pc.fill_null(columns[4], 0).to_numpy(zero_copy_only=False)[ended])
    known = np.bincount(ladder[ended], minlength=size) > 0
    named = shown & columns[1].is_valid().to_numpy(zero_copy_only=False)
    reference = np.full(size, files)
    np.minimum.at(reference, ladder[named], owner[named])

    packed = columns[2].filter(pa.array(~shown))
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8 if len(packed) else np.zeros(1, np.int64)
    n = np.diff(edges)
    t = np.cumsum(np.frombuffer(packed.buffers()[2], "<i8")[edges[0] : edges[-1]]) if n.sum() else np.zeros(0, np.int64)
    at = edges[:-1] - edges[0]
    t -= np.repeat(np.concatenate([[0], t])[at], n)
    file = np.repeat(owner[~shown], n)
    keep = renditions[of[file]] > 0
    file, t = file[keep], t[keep]
    if ((file[1:] == file[:-1]) & (t[1:] < t[:-1])).any():
        order = np.lexsort((t, file))
        file, t = file[order], t[order]
    place = of[file]

    keys = np.bincount(file, minlength=files)
    bare = np.bincount(ladder[shown & ((keys[owner] == 0) | ~columns[1].is_valid().to_numpy(zero_copy_only=False))], minlength=size)
    file_first = np.cumsum(keys) - keys
    late = t - t[file_first[file]] + tol[place] if len(t) else t
    fits, aligned = [], []
    for length in lengths:
        cut, j = _cut(file_first, file, late, length)
        where, when = place[cut], t[cut]
        cuts = np.bincount(file[cut], minlength=files + 1)
        starts, ref = np.cumsum(cuts) - cuts, reference[where]
        paired = j < cuts[ref]
        other = when[np.where(paired, starts[ref] + j, 0)] if len(when) else when
        off = np.bincount(where[~paired | (np.abs(when - other) > tol[where])], minlength=size)
        own = np.flatnonzero((cuts[:files] > 0) & (cuts[:files] != cuts[reference[of]]))
        off += np.bincount(of[own], minlength=size)
        even = (off == 0) & (cuts[reference] > 0)
        mine = np.flatnonzero(file[cut] == ref)
        last = j[mine] == cuts[ref[mine]] - 1
        end = np.where(last, fin[where[mine]], np.append(when, 0)[mine + 1])
        over = (end - when[mine] > length + np.maximum(tol[where[mine]], length // 100)) & (~last | known[where[mine]])
        aligned.append(even)
        fits.append(even & (np.bincount(where[mine[over]], minlength=size) == 0))

    order = np.argsort(lengths, kind="stable")
    fit = np.array(fits).reshape(len(lengths), size)[order].T
    seconds = np.broadcast_to(np.array(lengths, np.float64)[order] / 1_000_000, fit.shape)[fit]
    fitting = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fit.sum(axis=1))]).astype(np.int32)), pa.array(seconds))
    out = pa.table({
        "ladder": columns[0].take(pa.array(np.flatnonzero(begins))), "bare": pa.array(bare), "unmatched": pa.array(_unmatched(place, file, t, tol, renditions)),
        "fitting": fitting, "aligned_lengths": pa.array(np.array(aligned, np.int64).reshape(len(lengths), size).sum(axis=0)),
    })
    return out.filter(pa.array(renditions > 0))


def compared(renditions: DataFrame, keys: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(ladder, bare, unmatched, fitting, aligned_lengths): renditions without keys, the number of :func:`unmatched_keys`, and
    of :func:`segment_plans` the lengths in seconds that cut all renditions alike with no long segment, and how many do the former.

    Key frames travel once, as a row by run of a file, to where their ladder is sorted by file and then read as a stream of
    whole ladders; nothing is made by pair of renditions or by length. The keys of one ladder have to fit a task's memory.
    """
    ship(keys.sparkSession)
    kind, name = keys.schema["ladder"].dataType, keys.schema["file"].dataType
    known = keys.select("ladder", "file", F.col("t").cast("long").alias("t")).where("ladder is not null and file is not null and t is not null")
    packed = known.mapInArrow(_pack, StructType([StructField("ladder", kind), StructField("file", name), *keys.sparkSession.createDataFrame([], "times binary").schema]))
    shown = renditions.where("ladder is not null").select(F.col("ladder").cast(kind).alias("ladder"), F.col("file").cast(name).alias("file"), F.lit(None).cast("binary").alias("times"), F.col("fps").cast("double").alias("fps"), F.col("fin").cast("long").alias("fin"))
    rows = shown.unionByName(packed, allowMissingColumns=True).repartition("ladder").sortWithinPartitions("ladder", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += batch.num_rows + batch.column(2).nbytes // 8
            if weight < CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(rows.column("ladder").combine_chunks()))[-1])
            if last:
                yield from _compare(rows.slice(0, last), lengths).to_batches()
            held = rows.slice(last).combine_chunks().to_batches()
            weight = CHUNK // 2 if last == 0 else 0  # a ladder that goes on is looked through again after as many rows more
        if held:
            yield from _compare(pa.Table.from_batches(held), lengths).to_batches()

    schema = StructType([StructField("ladder", kind), StructField("bare", LongType()), StructField("unmatched", LongType()), StructField("fitting", ArrayType(DoubleType())), StructField("aligned_lengths", LongType())])
    return rows.mapInArrow(run, schema)


def with_steps(renditions: DataFrame) -> DataFrame:
    """``renditions`` with ``step``: how many times the bitrate goes into that of the next larger rendition, of those with a bitrate."""
    rated = F.coalesce(F.col("bitrate") > 0, F.lit(False))
    by = Window.partitionBy("ladder", rated).orderBy(F.desc("height"), F.desc("bitrate"), "file")
    return renditions.withColumn("step", F.when(rated, F.lag("bitrate").over(by).cast("double") / F.col("bitrate")))


def bitrate_steps(renditions: DataFrame) -> DataFrame:
    """(ladder, file, step): how many times the bitrate of the next smaller rendition goes into that of the larger."""
    return with_steps(renditions).where("bitrate > 0").select("ladder", "file", "step")


def mislabelled(width: Column, height: Column, label: Column) -> Column:
    """Whether a picture is larger than its name's size tier, or fits into the 16:9 frame of the tier below."""
    tiers = F.array(*[F.lit(t) for t in SIZE_TIERS])
    below = F.array_max(F.filter(tiers, lambda t: t < label))
    frame = F.floor(below * 16 / 9 / 2 + 0.5) * 2 + 2
    fits = (F.greatest(width, height) <= frame) & (F.least(width, height) <= below)
    return (F.least(width, height) > label + 1) | F.coalesce(fits, F.lit(False))


def facts(renditions: DataFrame, keys: DataFrame, segments: Sequence[float]) -> DataFrame:
    """One row by ladder of ``renditions`` (ladder, file, name, width, height, fps, bitrate, level, family, audio_codec,
    sample_rate, channels, fin) and their ``keys`` (ladder, file, t); times are microseconds, ``segments`` seconds."""
    c = F.col
    lengths = [int(round(s * 1_000_000)) for s in segments]
    label = text.label_height(c("name"))
    sized = c("label").isNotNull() & (c("width") > 0) & (c("height") > 0)
    audio = F.when(c("audio_codec").isNotNull(), F.concat_ws(" ", "audio_codec", "sample_rate", "channels")).otherwise("none")
    avc = (c("family") == "avc") & c("level").isNotNull()
    near = F.floor(c("step") * 100 + 0.5) / 100
    # what is told of a rendition by itself is told before rows move
    narrow = renditions.withColumn("label", label).select(
        "ladder", "file", "height", "bitrate", F.coalesce(F.floor(c("fps") * 100 + 0.5), F.lit(-1)).alias("rate"), audio.alias("audio"), c("audio_codec").isNotNull().alias("sounds"),
        c("label").isNotNull().alias("labels"), (sized & mislabelled(c("width"), c("height"), c("label"))).alias("wrong"), avc.alias("avc"), (avc & (c("level") <= 41)).alias("low"),
    )
    own = with_steps(narrow.repartition("ladder")).groupBy("ladder").agg(
        F.count("*").alias("renditions"), F.size(F.collect_set("rate")).cast("long").alias("rates"),
        F.count_if("sounds").alias("with_audio"), F.size(F.collect_set("audio")).cast("long").alias("audio_kinds"),
        F.count_if("labels").alias("labelled"), F.count_if("wrong").alias("mislabelled"), F.count_if("avc").alias("avc_levels"), F.count_if("low").alias("avc_low_levels"),
        F.count_if(c("bitrate") > 0).alias("rated"), F.count_if(c("step") < 1).alias("steps_up"), F.count_if((near < 1.4) | (near > 2.6)).alias("odd_steps"),
    )
    out = own.join(compared(renditions, keys, lengths).hint("merge"), "ladder", "left")
    return out.withColumns({
        "entity": c("ladder"), "all_have_keys": F.coalesce(c("bare") == 0, F.lit(False)), "unmatched_keys": F.coalesce("unmatched", F.lit(0)), "fitting_lengths": F.coalesce("fitting", F.array().cast("array<double>")), "aligned_lengths": F.coalesce("aligned_lengths", F.lit(0)),
    })
