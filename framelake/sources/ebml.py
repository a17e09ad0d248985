"""Matroska and WebM: elements, and blocks with their laces as samples."""

from __future__ import annotations

import struct

import numpy as np

from .files import Range, uint

# Ids of elements that hold others, and of those that are read.
MASTERS = {0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x114D9B74: "SeekHead", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xE0: "Video", 0xE1: "Audio", 0x1F43B675: "Cluster", 0xA0: "BlockGroup", 0x1C53BB6B: "Cues", 0xBB: "CuePoint", 0xB7: "CueTrackPositions"}
LEAVES = {
    0x4286: "EBMLVersion", 0x4282: "DocType", 0x2AD7B1: "TimestampScale", 0x4489: "Duration", 0xD7: "TrackNumber", 0x83: "TrackType", 0x86: "CodecID", 0x23E383: "DefaultDuration", 0x56AA: "CodecDelay", 0xB0: "PixelWidth", 0xBA: "PixelHeight", 0x9F: "Channels", 0xB5: "SamplingFrequency",
    0xE7: "Timestamp", 0xA3: "SimpleBlock", 0xA1: "Block", 0x9B: "BlockDuration", 0xFB: "ReferenceBlock", 0xEC: "Void", 0xBF: "CRC-32", 0xB3: "CueTime", 0xF7: "CueTrack", 0xF1: "CueClusterPosition",
}
TOP = (0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966, 0x114D9B74)
KINDS = {1: "video", 2: "audio", 17: "text"}
RESYNC = 16 << 20


def probe(head: bytes, size: int) -> int:
    return 100 if head[:4] == b"\x1a\x45\xdf\xa3" else 0


def vint(data: bytes, at: int, mark: bool = False) -> tuple[int | None, int]:
    """(number, place behind it) of variable length; with ``mark`` the length bit stays; all ones are None (unknown)."""
    if at >= len(data) or not data[at]:
        return None, len(data) + 1
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None, len(data) + 1
    value = uint(data, at, n)
    if mark:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def laces(body: bytes, at: int, kind: int) -> list[tuple[int, int]]:
    """(place, size) of the frames of a block whose data begin at ``at``: not laced, Xiph, fixed or EBML sizes."""
    if kind == 0 or at >= len(body):
        return [(at, len(body) - at)]
    n, at = body[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while at < len(body):
                size, at = size + body[at], at + 1
                if body[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3:
        for k in range(n - 1):
            start = at
            value, at = vint(body, at)
            if value is None:
                return []
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    else:
        sizes = [(len(body) - at) // n] * (n - 1)
    rest = len(body) - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        return []
    out = []
    for size in [*sizes, rest]:
        out.append((at, size))
        at += size
    return out


def elements(source: Range, lo: int, hi: int, parent: int, depth: int, out: list[dict], top: bool = False) -> int:
    """Elements of [lo, hi) in file order; unknown sizes end where an element of an upper level begins, and damage is
    passed over up to the next of those (S11). Gives the place where reading ended."""
    at = lo
    while at < hi:
        head = source.read(at, 12)
        own, p = vint(head, 0, mark=True)
        size, q = vint(head, p) if own is not None else (None, 0)
        known = own in MASTERS or own in LEAVES
        if own is None or q > len(head) or not known and (depth < 2 or size is None) and p > 4:
            begin, found = at, None
            data = source.read(at + 1, min(RESYNC, hi - at))
            marks = [data.find(uint.to_bytes(4, "big")) for uint in TOP]
            marks = [m for m in marks if m >= 0]
            found = at + 1 + min(marks) if marks else hi
            out.append({"id": len(out), "parent_id": parent, "depth": depth, "type": "damage", "kind": "gap", "offset": begin, "size": found - begin, "header_size": 0, "warnings": ["no element here"]})
            if depth > 1:
                return found
            at = found
            continue
        if depth > 1 and own in TOP:  # the end of an element of unknown size
            return at
        unknown = size is None
        end = hi if unknown else min(hi, at + q + size)
        node = {"id": len(out), "parent_id": parent, "depth": depth, "type": MASTERS.get(own) or LEAVES.get(own) or f"0x{own:X}", "kind": "element", "offset": at, "size": end - at, "header_size": q, "warnings": [] if unknown or at + q + size <= hi else ["runs past its parent"]}
        out.append(node)
        if own in MASTERS:
            stop = elements(source, at + q, end, node["id"], depth + 1, out)
            if unknown or stop < end and depth == 1:
                node["size"], end = stop - at, stop
        at = end
    return at


def read(source: Range) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    """(nodes, tracks, samples by track). Times are milliseconds times the file's scale of a millionth; a lace without times of
    its own has its share of the way to the next block (S12)."""
    nodes: list[dict] = []
    elements(source, 0, source.size, -1, 0, nodes, True)
    body = lambda n, most=1 << 26: source.read(n["offset"] + n["header_size"], min(n["size"] - n["header_size"], most))
    number = lambda n: uint(b := body(n), 0, len(b))
    real = lambda n: struct.unpack(">f" if len(b := body(n)) == 4 else ">d", b)[0] if n["size"] - n["header_size"] in (4, 8) else 0.0
    by_id = {n["id"]: n for n in nodes}
    scale = next((number(n) for n in nodes if n["type"] == "TimestampScale"), 1_000_000)
    tracks: list[dict] = []
    entry: dict[int, dict] = {}
    for n in nodes:
        if n["type"] == "TrackEntry":
            entry[n["id"]] = t = {"track": 0, "kind": "other", "codec": None, "timescale": 1_000_000_000 // max(1, scale), "duration": 0, "width": None, "height": None, "channels": None, "sample_rate": None, "default": None, "delay": None}
            tracks.append(t)
        up = n
        while up["parent_id"] >= 0 and up["id"] not in entry:
            up = by_id[up["parent_id"]]
        t = entry.get(up["id"])
        if t is None:
            continue
        field = {"TrackNumber": "track", "PixelWidth": "width", "PixelHeight": "height", "Channels": "channels", "DefaultDuration": "default", "CodecDelay": "delay"}.get(n["type"])
        if field:
            t[field] = number(n)
        elif n["type"] == "TrackType":
            t["kind"] = KINDS.get(number(n), "other")
        elif n["type"] == "CodecID":
            t["codec"] = body(n).rstrip(b"\0").decode("latin-1")
        elif n["type"] == "SamplingFrequency":
            t["sample_rate"] = int(real(n))
    cluster = 0
    rows: dict[int, list[list]] = {}
    group: dict[int, list] = {}
    for n in nodes:
        if n["type"] == "Timestamp":
            cluster = number(n)
        elif n["type"] == "BlockDuration" and n["parent_id"] in group:
            for r in group[n["parent_id"]]:
                r[5] = number(n)
        elif n["type"] == "ReferenceBlock" and n["parent_id"] in group:
            for r in group[n["parent_id"]]:
                r[4] = False
        elif n["type"] in ("SimpleBlock", "Block"):
            b = body(n)
            own, p = vint(b, 0)
            if own is None or p + 3 > len(b):
                continue
            flags = b[p + 2]
            time = cluster + int.from_bytes(b[p : p + 2], "big", signed=True)
            found = laces(b, p + 3, flags >> 1 & 3)
            key = bool(flags & 0x80) if n["type"] == "SimpleBlock" else True
            own_rows = rows.setdefault(own, [])
            nth = own_rows[-1][6] + 1 if own_rows else 0
            new = [[n["offset"] + n["header_size"] + at, size, time, lace, key, None, nth, len(found)] for lace, (at, size) in enumerate(found)]
            own_rows += new
            if n["type"] == "Block":
                group.setdefault(n["parent_id"], []).extend(new)
    samples = {}
    for t in tracks:
        own = rows.get(t["track"], [])
        if not own:
            continue
        starts = {r[6]: r[2] for r in own}
        order = sorted(starts)
        after = {b: starts[order[k + 1]] for k, b in enumerate(order[:-1])}
        share = []
        for r in own:
            if r[5] is not None:
                share.append(r[5] / r[7])
            elif t["default"]:
                share.append(t["default"] / max(1, scale))
            else:
                share.append(max(0, after.get(r[6], r[2]) - r[2]) / r[7])
        share = np.array(share)
        pts = np.floor(np.array([r[2] for r in own]) + np.array([r[3] for r in own]) * share + 0.5).astype(np.int64)
        # frames lie in decoding order: the sorted times, moved back so that none is decoded after it is shown
        ranked = np.sort(pts)
        dts = ranked - max(0, int((ranked - pts).max()))
        t["duration"] = int(pts.max() + share[int(pts.argmax())] - pts.min())
        samples[t["track"]] = {"offset": np.array([r[0] for r in own], np.int64), "size": np.array([r[1] for r in own], np.int64), "dts": dts, "duration": np.floor(share + 0.5).astype(np.int64), "cto": pts - dts, "key": np.array([r[4] for r in own])}
    return nodes, [{k: v for k, v in t.items() if k not in ("default", "delay")} for t in tracks], samples
