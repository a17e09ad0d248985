"""Media files as nodes, tracks and samples: every file is read by ranges in one task, and files are dealt over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import ebml, es, flv, mp4, riff, ts
from .files import open_range

#: Containers in the order in which they are tried; the highest score wins, the first of equal ones.
FORMATS = {"isobmff": mp4, "matroska": ebml, "mpegts": ts, "riff": riff, "flv": flv, "es": es}

NODES = "file string, format string, id long, parent_id long, depth int, type string, kind string, offset long, size long, header_size long, warnings array<string>"
TRACKS = "file string, format string, track long, kind string, codec string, timescale long, duration long, width int, height int, channels int, sample_rate int"
SAMPLES = "file string, track long, i long, offset long, size long, dts long, cto long, pts long, duration long, timescale long, key boolean, letter string"
PACKETS = "file string, pid int, i long, counter int, payload boolean, discontinuity boolean, start boolean, error boolean, scrambled boolean, offset long, pcr long"
PES = "file string, pid int, i long, offset long, size long, pts long, dts long, access boolean, ended string"
ERRORS = "file string, format string, error string"


def detect(head: bytes, size: int) -> str | None:
    best, score = None, 0
    for name, module in FORMATS.items():
        s = module.probe(head, size)
        if s > score:
            best, score = name, s
    return best


def _ts(source) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    found = ts.read(source, every=False)
    nodes = [{"id": k, "parent_id": -1, "depth": 0, "type": "lost", "kind": "gap", "offset": r["offset"], "size": r["size"], "header_size": 0, "warnings": ["no sync byte"]} for k, r in enumerate(found["lost"])]
    samples = {}
    for t in found["tracks"]:
        pes = [p for p in found["pes"] if p["pid"] == t["track"] and p["dts"] is not None]
        if not pes:
            continue
        dts, pts = (np.array([p[c] for p in pes], np.int64) for c in ("dts", "pts"))
        unwrapped = np.concatenate([[dts[0]], dts[0] + np.cumsum((np.diff(dts) + (1 << 32)) % (1 << 33) - (1 << 32))])
        steps = np.diff(unwrapped)
        good = steps[(steps > 0) & (steps < 900_000)]
        duration = np.append(np.where((steps > 0) & (steps < 900_000), steps, 0), good[-1] if len(good) else 0)
        cto = (pts - dts + (1 << 32)) % (1 << 33) - (1 << 32)
        key = np.array([p["access"] for p in pes])
        samples[t["track"]] = {"offset": np.array([p["offset"] for p in pes]), "size": np.array([p["size"] for p in pes]), "dts": unwrapped, "duration": duration, "cto": cto, "key": key if key.any() else None}
        t["duration"] = int(duration.sum())
    return nodes, found["tracks"], samples


def open_media(path: str) -> tuple[str | None, list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    """(format, nodes, tracks, samples by track) of a file."""
    source = open_range(path)
    try:
        name = detect(source.read(0, 64 << 10), source.size)
        if name is None:
            return None, [], [], {}
        return (name, *(_ts(source) if name == "mpegts" else FORMATS[name].read(source)))
    finally:
        source.close()


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fitting(row: dict, schema: str) -> dict:
    """``row`` without numbers that its columns can't hold, as damaged files have them."""
    most = {c.split()[0]: 1 << (63 if c.endswith("long") else 31) for c in schema.split(", ") if c.endswith(("long", "int"))}
    return {k: None if k in most and isinstance(v, int) and not -most[k] <= v < most[k] else v for k, v in row.items()}


def _rows(kind: str, schema: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _columns(schema)
        for batch in batches:
            for path in batch["path"]:
                try:
                    name, nodes, tracks, samples = open_media(path)
                    error = None if name else "unknown format"
                except Exception as e:  # a file that can't be read is a row of errors, and the others go on
                    name, nodes, tracks, samples, error = None, [], [], {}, f"{type(e).__name__}: {e}"
                if kind == "errors":
                    if error:
                        yield pd.DataFrame([(path, name, error)], columns=names)
                elif kind == "samples":
                    scale = {t["track"]: _fitting(t, TRACKS)["timescale"] for t in tracks}
                    for track, s in samples.items():
                        held = (s["offset"] >= 0) & (s["size"] >= 0)  # what a damaged table puts nowhere is no frame
                        s = s if held.all() else {c: v if v is None else v[held] for c, v in s.items()}
                        n = len(s["size"])
                        none = np.full(n, None, object)
                        cto = s.get("cto")
                        yield pd.DataFrame({
                            "file": path, "track": track, "i": np.arange(n), "offset": s["offset"], "size": s["size"], "dts": s["dts"], "cto": none if cto is None else cto, "pts": s["dts"] + (0 if cto is None else cto),
                            "duration": s["duration"], "timescale": scale.get(track), "key": none if s.get("key") is None else s["key"], "letter": s.get("letter", none),
                        })[names]
                else:
                    rows = nodes if kind == "nodes" else tracks
                    if rows:
                        yield pd.DataFrame([{"file": path, "format": name} | _fitting(r, schema) for r in rows], dtype=object).reindex(columns=names)

    return run


def _read(files: DataFrame, kind: str, schema: str) -> DataFrame:
    return files.select("path").mapInPandas(_rows(kind, schema), schema)


def nodes(files: DataFrame) -> DataFrame:
    """The structure of each of ``files`` (path), in file order."""
    return _read(files, "nodes", NODES)


def tracks(files: DataFrame) -> DataFrame:
    return _read(files, "tracks", TRACKS)


def samples(files: DataFrame) -> DataFrame:
    """One row by frame of each track, in decoding order."""
    return _read(files, "samples", SAMPLES)


def errors(files: DataFrame) -> DataFrame:
    """Files that can't be read, and why."""
    return _read(files, "errors", ERRORS)


#: Families by the names that containers give their codecs.
FAMILIES = {
    "avc1": "avc", "avc3": "avc", "V_MPEG4/ISO/AVC": "avc", "H264": "avc", "hvc1": "hevc", "hev1": "hevc", "V_MPEGH/ISO/HEVC": "hevc", "av01": "av1", "V_AV1": "av1", "vp09": "vp9", "V_VP9": "vp9",
    "vp08": "vp8", "V_VP8": "vp8", "VP80": "vp8", "mp4v": "mpeg4v", "XVID": "mpeg4v", "V_MPEG4/ISO/ASP": "mpeg4v", "V_MPEG2": "mpeg2v",
}
TYPES = "file string, track long, i long, letter string, ref boolean, rap boolean, closed boolean, leading boolean, skippable boolean, hidden boolean"
#: Bytes from the front of a frame that are read first, and at most where they don't tell.
HEAD, FULL = 2 << 10, 8 << 20


def _types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            try:
                name, _, found, frames = open_media(path)
                source = open_range(path)
            except Exception:  # what can't be opened has a row in errors()
                continue
            for t in found:
                family = FAMILIES.get(t["codec"], t["codec"])
                if t["kind"] != "video" or t["track"] not in frames:
                    continue
                sized = name in ("isobmff", "flv", "matroska") and family in ("avc", "hevc")
                state: dict = {}
                rows = []
                for i, (offset, size) in enumerate(zip(frames[t["track"]]["offset"].tolist(), frames[t["track"]]["size"].tolist(), strict=True)):
                    got = es.classify(family, source.read(offset, min(size, HEAD)), state, 4 if sized else None)
                    if got["kind"] == "?" and size > HEAD:
                        got = es.classify(family, source.read(offset, min(size, FULL)), state, 4 if sized else None)
                    rows.append((path, t["track"], i, got["kind"], *(bool(got.get(f)) for f in ("ref", "rap", "closed", "leading", "skippable", "hidden"))))
                yield pd.DataFrame(rows, columns=_columns(TYPES))
            source.close()


def frame_types(files: DataFrame) -> DataFrame:
    """The kind of picture of each frame of the video tracks, from its first bytes, in decoding order."""
    return files.select("path").mapInPandas(_types, TYPES)


def extracted_audio(files: DataFrame, track: int, rate: int, channels: int) -> DataFrame:
    """(file, data): the AAC frames of a track with a header before each, read in runs that lie side by side."""
    from .audio import adts_header

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                frames = open_media(path)[3].get(track)
                if frames is None:
                    continue
                source, out = open_range(path), []
                offset, size = frames["offset"], frames["size"]
                cut = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1] + size[:-1]]))
                for a, b in zip(cut, [*cut[1:], len(size)], strict=True):
                    data, at = source.read(int(offset[a]), int(size[a:b].sum())), 0
                    for n in size[a:b].tolist():
                        out.append(adts_header(n, rate, channels) + data[at : at + n])
                        at += n
                source.close()
                yield pd.DataFrame([(path, b"".join(out))], columns=["file", "data"])

    return files.select("path").mapInPandas(run, "file string, data binary")


def _ts_rows(part: str, schema: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                source = open_range(path)
                rows = ts.read(source)[part]
                source.close()
                if rows:
                    yield pd.DataFrame([{"file": path} | r for r in rows]).reindex(columns=_columns(schema)).astype(object).where(lambda d: d.notna(), None)

    return run


def ts_packets(files: DataFrame) -> DataFrame:
    return files.select("path").mapInPandas(_ts_rows("packets", PACKETS), PACKETS)


def pes_packets(files: DataFrame) -> DataFrame:
    return files.select("path").mapInPandas(_ts_rows("pes", PES), PES)


def range_digests(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, offset, size) with the SHA-256 of their bytes (K7)."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, offset, size in zip(batch["path"], batch["offset"], batch["size"], strict=True):
                source = open_range(path)
                digest = hashlib.sha256()
                for at in range(offset, offset + size, 4 << 20):
                    digest.update(source.read(at, min(4 << 20, offset + size - at)))
                source.close()
                out.append(digest.hexdigest())
            yield batch.assign(sha256=out)

    return ranges.join(files.select("path"), "path").select("path", "offset", "size").mapInPandas(run, "path string, offset long, size long, sha256 string")


def tree(node_rows: DataFrame) -> DataFrame:
    """A line of text by node, indented, in file order (K5)."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("type"), F.lit(" "), F.col("offset"), F.lit("+"), F.col("size"), F.when(F.size("warnings") > 0, F.concat(F.lit("  ! "), F.array_join("warnings", "; "))).otherwise(""))
    return node_rows.select("file", "id", line.alias("line")).orderBy("file", "id")
