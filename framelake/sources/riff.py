"""RIFF: chunks of WAV and AVI, and samples by index, by the movie list, or by block size."""

from __future__ import annotations

import numpy as np

from .files import Range, table, uint

LISTS = (b"RIFF", b"RIFX", b"RF64", b"LIST")
#: Names of the sample formats of WAVE.
FORMATS = {1: "pcm", 2: "adpcm-ms", 3: "float", 6: "alaw", 7: "mulaw", 0x11: "adpcm-ima", 0x50: "mp2", 0x55: "mp3", 0xFF: "aac", 0xFFFE: "pcm"}


def probe(head: bytes, size: int) -> int:
    return 100 if head[:4] in LISTS[:3] and head[8:12] in (b"WAVE", b"AVI ", b"AVIX") else 30 if head[:4] in LISTS[:3] else 0


def chunks(source: Range, lo: int = 0, hi: int | None = None, parent: int = -1, depth: int = 0, out: list | None = None, state: dict | None = None) -> list[dict]:
    """All chunks in file order (S19): either byte order, padding to even places, and the long sizes of RF64."""
    out, state = ([] if out is None else out), ({} if state is None else state)
    hi, at = source.size if hi is None else hi, lo
    while at + 8 <= hi:
        head = source.read(at, 12)
        kind = head[:4]
        if kind == b"RIFX":
            state["big"] = True
        n, warnings = uint(head, 4, 4, not state.get("big")), []
        if n == 0xFFFFFFFF and "ds64" in state:
            n = state["ds64"][0 if kind == b"RF64" else 1]
        if at + 8 + n > hi:
            n, warnings = hi - at - 8, ["runs past its parent"]
        is_list = kind in LISTS
        node = {"id": len(out), "parent_id": parent, "depth": depth, "type": (head[8:12] if is_list else kind).decode("latin-1"), "kind": "list" if is_list else "chunk", "offset": at, "size": 8 + n, "header_size": 12 if is_list else 8, "warnings": warnings}
        out.append(node)
        if kind == b"ds64":
            body = source.read(at + 8, 24)
            state["ds64"] = (uint(body, 0, 8, True), uint(body, 8, 8, True))
        if is_list and n >= 4:
            chunks(source, at + 12, at + 8 + n, node["id"], depth + 1, out, state)
        at += 8 + n + (n & 1)
    return out


def _clock(stream: dict, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ticks before each chunk, ticks of each) by bytes, blocks or frames."""
    if stream["sample_size"] > 1 or stream["sample_size"] == 1 and stream["kind"] == "audio":
        end = np.cumsum(sizes) // stream["sample_size"]
    elif stream["kind"] == "audio" and stream["align"] > 1:
        end = np.cumsum(-(-sizes // stream["align"]))
    else:
        end = np.arange(1, len(sizes) + 1)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    return start, end - start


def read(source: Range) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    nodes = chunks(source)
    body = lambda n, most=1 << 24: source.read(n["offset"] + n["header_size"], min(n["size"] - n["header_size"], most))
    of = lambda kind, parent=None: [n for n in nodes if n["type"] == kind and (parent is None or n["parent_id"] == parent["id"])]
    little = source.read(0, 4) != b"RIFX"
    if of("WAVE"):
        fmt, data = of("fmt "), of("data")
        if not fmt or not data:
            return nodes, [], {}
        b = body(fmt[0])
        code, n, rate, align, bits = uint(b, 0, 2, little), uint(b, 2, 2, little), uint(b, 4, 4, little), uint(b, 12, 2, little), uint(b, 14, 2, little)
        size, per = data[0]["size"] - 8, uint(b, 18, 2, little) if code in (2, 0x11) and len(b) >= 20 else 1
        block = max(1, align) * (max(1, rate // 10) if per == 1 else 1)  # a tenth of a second of plain samples as one
        at = np.arange(0, size, block, dtype=np.int64)
        sizes = np.minimum(block, size - at)
        ticks = sizes // max(1, align) * per
        track = {"track": 1, "kind": "audio", "codec": FORMATS.get(code, f"0x{code:04x}"), "timescale": rate, "duration": int(ticks.sum()), "width": None, "height": None, "channels": n, "sample_rate": rate, "bits": bits}
        return nodes, [track], {1: {"offset": data[0]["offset"] + 8 + at, "size": sizes, "dts": np.cumsum(ticks) - ticks, "duration": ticks, "cto": None, "key": None}}
    tracks, streams = [], []
    for k, strl in enumerate(of("strl")):
        strh, strf = (body(x[0]) if (x := of(c, strl)) else b"" for c in ("strh", "strf"))
        if len(strh) < 48:
            continue
        kind = {b"vids": "video", b"auds": "audio", b"txts": "text"}.get(strh[:4], "other")
        scale, rate = max(1, uint(strh, 20, 4, True)), max(1, uint(strh, 24, 4, True))
        code = strf[16:20].decode("latin-1") if kind == "video" else FORMATS.get(uint(strf, 0, 2, True)) if kind == "audio" else None
        streams.append({"n": k, "kind": kind, "scale": scale, "sample_size": uint(strh, 44, 4, True), "align": uint(strf, 12, 2, True) if kind == "audio" and len(strf) >= 14 else 1})
        tracks.append({"track": k + 1, "kind": kind, "codec": code, "timescale": rate, "duration": 0, "width": uint(strf, 4, 4, True) if kind == "video" and len(strf) >= 12 else None, "height": abs(int.from_bytes(strf[8:12], "little", signed=True)) if kind == "video" and len(strf) >= 12 else None,
                       "channels": uint(strf, 2, 2, True) if kind == "audio" and len(strf) >= 8 else None, "sample_rate": uint(strf, 4, 4, True) if kind == "audio" and len(strf) >= 8 else None})
    movi = of("movi")
    entries: list[tuple[int, int, int, bool]] = []
    index = of("idx1")
    if index and movi:
        got = table(body(index[0], 1 << 30), 0, 1 << 28, "S4,<u4,<u4,<u4")
        base = movi[0]["offset"] + 8
        # offsets count from one of these places; the first that finds the chunks that the index names is taken
        for origin in (base, 0, base + 4, base - 8):
            some = got[: 8]
            if len(some) and all(source.read(origin + int(e["f2"]), 4) == e["f0"].ljust(4, b"\0") for e in some):
                entries = [(int(e["f0"][:2]), origin + int(e["f2"]) + 8, int(e["f3"]), bool(e["f1"] & 0x10)) for e in got if e["f0"][:2].isdigit()]
                break
    if not entries:
        inside = {m["id"] for m in movi} | {n["id"] for n in nodes if n["type"] == "rec "}
        entries = [(int(n["type"][:2]), n["offset"] + 8, n["size"] - 8, True) for n in nodes if n["parent_id"] in inside and n["type"][:2].isdigit() and n["type"][2:4] in ("dc", "db", "wb", "tx")]
    samples = {}
    for s, t in zip(streams, tracks, strict=True):
        own = [e for e in entries if e[0] == s["n"]]
        if not own:
            continue
        sizes = np.array([e[2] for e in own], np.int64)
        start, ticks = _clock(s, sizes)
        t["duration"] = int(ticks.sum()) * s["scale"]
        samples[t["track"]] = {"offset": np.array([e[1] for e in own], np.int64), "size": sizes, "dts": start * s["scale"], "duration": ticks * s["scale"], "cto": None, "key": np.array([e[3] for e in own]) if s["kind"] == "video" else None}
    return nodes, tracks, samples
