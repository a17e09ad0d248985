"""FLV: tags, script data, and samples of the audio and video streams."""

from __future__ import annotations

import struct

import numpy as np

from .files import Range, uint

#: How far a lost reader looks for the next tag.
RESYNC = 1 << 20
VIDEO = {2: "h263s", 4: "vp6", 5: "vp6a", 7: "avc", 12: "hevc", 13: "av1"}
AUDIO = {1: "adpcm", 2: "mp3", 3: "pcm", 10: "aac", 11: "speex"}
#: Enhanced tags carry the codec as four characters.
FOURCC = {b"avc1": "avc", b"hvc1": "hevc", b"av01": "av1", b"vp09": "vp9", b"mp4a": "aac", b"Opus": "opus", b"fLaC": "flac", b"ac-3": "ac3", b"ec-3": "eac3", b".mp3": "mp3"}


def probe(head: bytes, size: int) -> int:
    return 100 if head[:3] == b"FLV" and head[3:4] in (b"\x01",) else 0


def amf(data: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """(value, place behind it) of AMF0; what can't be read is None at the end."""
    if at >= len(data) or depth > 32:
        return None, len(data)
    kind, at = data[at], at + 1
    if kind == 0 and at + 8 <= len(data):
        return struct.unpack_from(">d", data, at)[0], at + 8
    if kind == 1:
        return data[at : at + 1] == b"\x01", at + 1
    if kind in (2, 12):
        wide = 2 if kind == 2 else 4
        n = uint(data, at, wide)
        return data[at + wide : at + wide + n].decode("utf-8", "replace"), at + wide + n
    if kind in (3, 8):
        at += 4 if kind == 8 else 0
        out = {}
        while at + 2 <= len(data):
            n = uint(data, at, 2)
            if n == 0 and data[at + 2 : at + 3] == b"\x09":
                return out, at + 3
            name = data[at + 2 : at + 2 + n].decode("utf-8", "replace")
            out[name], at = amf(data, at + 2 + n, depth + 1)
        return out, len(data)
    if kind == 10:
        n, at, items = uint(data, at, 4), at + 4, []
        while len(items) < n and at < len(data):
            item, at = amf(data, at, depth + 1)
            items.append(item)
        return items, at
    if kind == 11 and at + 10 <= len(data):
        return struct.unpack_from(">d", data, at)[0], at + 10
    return None, at if kind in (5, 6) else len(data)


def _tag_at(source: Range, at: int) -> int | None:
    """The size of a whole tag at ``at`` whose repeated size agrees, or None."""
    head = source.read(at, 11)
    if len(head) < 11 or head[0] & 0x1F not in (8, 9, 18) or head[8:11] != b"\0\0\0":
        return None
    n = uint(head, 1, 3)
    tail = source.read(at + 11 + n, 4)
    return n if len(tail) == 4 and uint(tail, 0, 4) == 11 + n else None


def read(source: Range) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    """(nodes, tracks, samples by track): track 1 is video, 2 audio. Between tags, lost ranges are nodes of their own."""
    nodes: list[dict] = []
    node = lambda kind, offset, size, header, **more: nodes.append({"id": len(nodes), "parent_id": -1, "depth": 0, "type": kind, "kind": "tag", "offset": offset, "size": size, "header_size": header, "warnings": []} | more)
    at = max(9, uint(source.read(5, 4), 0, 4))
    node("header", 0, at, at)
    at += 4
    rows: dict[int, dict[str, list]] = {t: {c: [] for c in ("offset", "size", "dts", "cto", "key")} for t in (1, 2)}
    codec: dict[int, str | None] = {}
    facts: dict = {}
    while at + 11 <= source.size:
        n = _tag_at(source, at)
        head = source.read(at, 11)
        if n is None and head[0] & 0x1F in (8, 9, 18) and at + 11 + uint(head, 1, 3) >= source.size - 3:
            n = min(uint(head, 1, 3), source.size - at - 11)  # the last tag, cut off or without its repeated size
        if n is None:
            limit = min(source.size - 15, at + RESYNC)
            data = source.read(at + 1, limit - at + 1)
            found = next((at + 1 + k for k in range(len(data)) if data[k] & 0x1F in (8, 9, 18) and _tag_at(source, at + 1 + k) is not None), None)
            node("lost", at, (found or source.size) - at, 0, warnings=["no tag here"])
            if found is None:
                break
            at = found
            continue
        kind = head[0] & 0x1F
        time = uint(head, 4, 3) | head[7] << 24
        time -= (time >> 31) << 32
        body = source.read(at + 11, min(n, 16))
        node({8: "audio", 9: "video", 18: "script"}[kind], at, 11 + n, 11)
        if kind == 18:
            name, p = amf(source.read(at + 11, min(n, 1 << 20)))
            value, _ = amf(source.read(at + 11, min(n, 1 << 20)), p)
            if name == "onMetaData" and isinstance(value, dict):
                facts = value
        elif body:
            own, skip, cto, key, config = 1 if kind == 9 else 2, 1, 0, True, False
            if kind == 9:
                key, what = body[0] >> 4 & 7 == 1, body[0] & 15
                if body[0] & 0x80:
                    codec.setdefault(1, FOURCC.get(body[1:5], body[1:5].decode("latin-1")))
                    skip, config = 5, what in (0, 2, 4)
                    if what == 1 and body[1:5] in (b"hvc1", b"avc1"):
                        cto, skip = int.from_bytes(body[5:8], "big", signed=True), 8
                else:
                    codec.setdefault(1, VIDEO.get(what))
                    if what in (7, 12):
                        config, cto, skip = body[1:2] != b"\x01", int.from_bytes(body[2:5], "big", signed=True), 5
                if body[0] >> 4 & 7 == 5:
                    config = True
            elif body[0] >> 4 == 9:
                codec.setdefault(2, FOURCC.get(body[1:5]))
                skip, config = 5, body[0] & 15 != 1
            else:
                codec.setdefault(2, AUDIO.get(body[0] >> 4))
                if body[0] >> 4 == 10:
                    skip, config = 2, body[1:2] == b"\0"
            if not config and n > skip:
                for c, v in (("offset", at + 11 + skip), ("size", n - skip), ("dts", time), ("cto", cto), ("key", key)):
                    rows[own][c].append(v)
        at += 11 + n + 4
    tracks, samples = [], {}
    for own, kind in ((1, "video"), (2, "audio")):
        if not rows[own]["size"]:
            continue
        dts = np.array(rows[own]["dts"], np.int64)
        steps = np.diff(dts)
        last = float(np.median(steps[:1000])) if len(steps) else 0.0
        samples[own] = {c: np.array(v) for c, v in rows[own].items()} | {"dts": dts, "duration": np.append(steps, int(last)).astype(np.int64)}
        tracks.append({"track": own, "kind": kind, "codec": codec.get(own), "timescale": 1000, "duration": int(samples[own]["duration"].sum()), "width": int(facts.get("width") or 0) or None if own == 1 else None, "height": int(facts.get("height") or 0) or None if own == 1 else None, "channels": None, "sample_rate": None})
    return nodes, tracks, samples
