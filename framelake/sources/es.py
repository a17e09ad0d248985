"""Raw H.264, HEVC and MPEG-2 video: NAL units, bits of their headers, and access units as samples."""

from __future__ import annotations

import numpy as np

from .files import Range

FALLBACK = 25.0


class Bits:
    """Bits from the front of a unit, without its emulation prevention."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\0\0\3", b"\0\0")
        self.at = 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.data) * 8:
            raise EOFError
        a, b = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise EOFError
        return (1 << zeros) - 1 + (self.u(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it) of seven bits a byte, low ones first."""
    value = 0
    for k in range(8):
        value |= (data[at + k] & 0x7F) << 7 * k
        if not data[at + k] & 0x80:
            return value, at + k + 1
    raise ValueError("too long")


def start_codes(data: np.ndarray) -> np.ndarray:
    """Places behind each 00 00 01."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == 0) & (data[1:-1] == 0) & (data[2:] == 1)) + 3


def annex_b(data: bytes) -> list[tuple[int, int]]:
    """(place, size) of the units between start codes (E5)."""
    x = np.frombuffer(data, np.uint8)
    begin = start_codes(x).tolist()
    out = []
    for k, a in enumerate(begin):
        b = begin[k + 1] - 3 if k + 1 < len(begin) else len(data)
        while b > a and data[b - 1] == 0:
            b -= 1
        out.append((a, b - a))
    return out


def length_prefixed(data: bytes, width: int = 4) -> list[tuple[int, int]]:
    """(place, size) of units that each have their size before them (E5); a size that doesn't fit ends the list."""
    at, out = 0, []
    while at + width <= len(data):
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if not n or at + n > len(data):
            break
        out.append((at, n))
        at += n
    return out


def avc_sps(unit: bytes) -> dict:
    """Profile, level, size and frame rate of an H.264 sequence parameter set; what can't be read is missing."""
    out: dict = {}
    try:
        r = Bits(unit[1:])
        out["profile"], compat, out["level"] = r.u(8), r.u(8), r.u(8)
        out["low_rate_1b"] = bool(compat & 0x10)
        r.ue()
        chroma = 1
        if out["profile"] in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135):
            chroma = r.ue()
            if chroma == 3:
                r.u(1)
            out["depth"] = r.ue() + 8
            r.ue()
            r.u(1)
            if r.u(1):
                for k in range(8 if chroma != 3 else 12):
                    if r.u(1):
                        last = following = 8
                        for _ in range(16 if k < 6 else 64):
                            if following:
                                following = (last + r.se()) % 256
                            last = following or last
        r.ue()
        kind = r.ue()
        if kind == 0:
            r.ue()
        elif kind == 1:
            r.u(1), r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        out["refs"] = r.ue()
        r.u(1)
        w, h = r.ue() + 1, r.ue() + 1
        frame = r.u(1)
        if not frame:
            r.u(1)
        r.u(1)
        left = right = top = bottom = 0
        if r.u(1):
            left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
        cx, cy = (1 if chroma in (0, 3) else 2), (2 if chroma == 1 else 1) * (2 - frame)
        out["width"], out["height"] = w * 16 - cx * (left + right), h * 16 * (2 - frame) - cy * (top + bottom)
        if r.u(1):
            if r.u(1) and r.u(8) == 255:
                out["sar"] = (r.u(16), r.u(16))
            if r.u(1):
                r.u(1)
            if r.u(1):
                r.u(3)
                out["full_range"] = bool(r.u(1))
                if r.u(1):
                    out["primaries"], out["transfer"], out["matrix"] = r.u(8), r.u(8), r.u(8)
            if r.u(1):
                r.ue(), r.ue()
            if r.u(1):
                units, scale = r.u(32), r.u(32)
                out["fps"] = scale / units / 2 if units else None
    except EOFError:
        out["cut"] = True
    return out


def avc_frame(units: list[bytes]) -> dict:
    """Kind (I, P, B), whether others refer to it, and whether decoding can start there, of the units of a frame."""
    out = {"kind": "?", "ref": False, "rap": False}
    recovery = any(u[0] & 31 == 6 and len(u) > 1 and u[1] == 6 for u in units if u)
    for u in units:
        kind = u[0] & 31 if u else 0
        if kind in (1, 2, 5):
            try:
                r = Bits(u[1:16])
                r.ue()
                out["kind"] = "PBIPI"[r.ue() % 5]
            except EOFError:
                pass
            out["ref"], out["rap"] = bool(u[0] >> 5 & 3), kind == 5 or recovery and out["kind"] == "I"
            out["closed"] = kind == 5
            break
    return out


def hevc_frame(units: list[bytes]) -> dict:
    for u in units:
        kind = u[0] >> 1 & 63 if len(u) > 2 else 99
        if kind <= 21:
            return {"kind": "I" if kind >= 16 else "?", "ref": not (kind < 16 and kind % 2 == 0), "rap": 16 <= kind <= 21, "leading": kind in (6, 7, 8, 9), "skippable": kind in (8, 9), "closed": kind in (19, 20)}
    return {"kind": "?", "ref": False, "rap": False}


def vp8_frame(data: bytes) -> dict:
    key = bool(data) and not data[0] & 1
    return {"kind": "?" if len(data) < 3 else "I" if key else "P", "ref": key, "rap": key, "hidden": len(data) > 2 and not data[0] >> 4 & 1}


def mpeg2_frame(data: bytes) -> dict:
    x = np.frombuffer(data, np.uint8)
    gop = seq = False
    for at in start_codes(x).tolist():
        code = data[at] if at < len(data) else 0xFF
        seq, gop = seq or code == 0xB3, gop or code == 0xB8
        if code == 0 and at + 2 < len(data):
            kind = "?IPBI???"[data[at + 2] >> 3 & 7]
            return {"kind": kind, "ref": kind != "B", "rap": kind == "I" and (gop or seq)}
    return {"kind": "?", "ref": False, "rap": False}


def mpeg4_frame(data: bytes) -> dict:
    """MPEG-4 Part 2; a frame that isn't coded repeats the one before."""
    closed = False
    for at in start_codes(np.frombuffer(data, np.uint8)).tolist():
        code = data[at] if at < len(data) else 0xFF
        if code == 0xB3 and at + 3 < len(data):
            closed = bool(data[at + 3] >> 5 & 1)
        if code == 0xB6 and at + 1 < len(data):
            kind = "IPBS"[data[at + 1] >> 6]
            return {"kind": kind, "ref": kind != "B", "rap": kind == "I", "closed": kind == "I" and closed}
    return {"kind": "?", "ref": False, "rap": False}


def vp9_frame(data: bytes) -> dict:
    """The first frame of a packet; one that only shows an earlier frame is a repeat."""
    try:
        r = Bits(data[:16])
        r.data = data[:16]
        if r.u(2) != 2:
            return {"kind": "?", "ref": False, "rap": False}
        profile = r.u(1) | r.u(1) << 1
        if profile == 3:
            r.u(1)
        if r.u(1):
            return {"kind": "=", "ref": False, "rap": False}
        key, shown, robust = not r.u(1), bool(r.u(1)), bool(r.u(1))
        intra = not key and not shown and bool(r.u(1))
        return {"kind": "I" if key or intra else "P", "ref": True, "rap": key, "closed": key, "hidden": not shown, "robust": robust}
    except EOFError:
        return {"kind": "?", "ref": False, "rap": False}


def av1_frame(data: bytes, state: dict | None = None) -> dict:
    """The first frame of a temporal unit; ``state`` carries what the last sequence header says."""
    state, at = ({} if state is None else state), 0
    while at < len(data):
        head = data[at]
        at += 2 if head & 4 else 1
        try:
            size, at = leb128(data, at) if head & 2 else (len(data) - at, at)
        except (IndexError, ValueError):
            break
        body = data[at : at + size]
        kind = head >> 3 & 15
        if kind == 1 and body:
            state["reduced"] = bool(body[0] >> 3 & 1)
        elif kind in (3, 6) and body:
            if state.get("reduced"):
                return {"kind": "I", "ref": True, "rap": True, "closed": True}
            if body[0] >> 7:
                return {"kind": "=", "ref": False, "rap": False}
            frame, shown = body[0] >> 5 & 3, bool(body[0] >> 4 & 1)
            return {"kind": "I" if frame in (0, 2) else "P", "ref": True, "rap": frame == 0 and shown, "closed": frame == 0, "hidden": not shown}
        at += size
    return {"kind": "?", "ref": False, "rap": False}


def vp6_frame(data: bytes) -> dict:
    key = bool(data) and not data[0] & 0x80
    return {"kind": "?" if not data else "I" if key else "P", "ref": True, "rap": key, "closed": key}


def sorenson_frame(data: bytes) -> dict:
    try:
        r = Bits(data[:16])
        r.data = data[:16]
        if r.u(17) != 1:
            return {"kind": "?", "ref": False, "rap": False}
        r.u(13)
        size = r.u(3)
        r.u(16 if size == 0 else 32 if size == 1 else 0)
        kind = r.u(2)
        return {"kind": "IPP?"[kind], "ref": kind < 2, "rap": kind == 0, "closed": kind == 0}
    except EOFError:
        return {"kind": "?", "ref": False, "rap": False}


def classify(family: str, data: bytes, state: dict, width: int | None = None) -> dict:
    """What kind of picture a frame of a codec family is, from its first bytes; ``width`` is that of the sizes before
    NAL units, None where start codes part them. ``state`` is carried from frame to frame in decoding order."""
    if family in ("avc", "hevc"):
        units = [data[a : a + n] for a, n in (length_prefixed_cut(data, width) if width else annex_b(data))]
        return avc_frame(units) if family == "avc" else hevc_frame(units)
    if family == "av1":
        return av1_frame(data, state)
    own = {"vp9": vp9_frame, "vp8": vp8_frame, "mpeg2v": mpeg2_frame, "mpeg4v": mpeg4_frame, "h263s": sorenson_frame, "vp6": vp6_frame, "vp6a": lambda d: vp6_frame(d[3:])}.get(family)
    return own(data) if own else {"kind": "?", "ref": False, "rap": False}


def length_prefixed_cut(data: bytes, width: int = 4) -> list[tuple[int, int]]:
    """As :func:`length_prefixed`, for the front of a frame: the last unit may be cut off."""
    at, out = 0, []
    while at + width < len(data):
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if not n:
            break
        out.append((at, min(n, len(data) - at)))
        at += n
    return out


def probe(head: bytes, size: int) -> int:
    return 35 if head[:4] in (b"\0\0\0\1", b"\0\0\1\xb3") or head[:3] == b"\0\0\1" and len(head) > 3 and head[3] & 0x80 == 0 else 0


def _family(head: bytes) -> str:
    if head[:4] == b"\0\0\1\xb3":
        return "mpeg2v"
    avc = hevc = 0
    for a, n in annex_b(head)[:16]:
        b = head[a]
        avc += b & 0x1F in (7, 8, 9) and not b & 0x80
        hevc += b >> 1 & 63 in (32, 33, 34, 35) and n > 1 and head[a + 1] & 7 == 1
    return "hevc" if hevc > avc else "avc"


def read(source: Range) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    """(nodes, tracks, samples): units as nodes, frames as samples of one track at the stream's frame rate.

    A frame begins at the first slice of a picture, or at what must stand before one.
    """
    data = source.read(0, source.size)
    family = _family(data[: 1 << 16])
    nodes, frames, fps, size = [], [], None, (None, None)
    fresh, cur = True, None
    for k, (a, n) in enumerate(annex_b(data) if family != "mpeg2v" else [(a, 0) for a in start_codes(np.frombuffer(data, np.uint8)).tolist()]):
        if family == "mpeg2v":
            code = data[a] if a < len(data) else 0xFF
            begins, picture = code in (0x00, 0xB3, 0xB8), code == 0
            if code == 0xB3 and a + 5 <= len(data):
                size = (data[a + 1] << 4 | data[a + 2] >> 4, (data[a + 2] & 15) << 8 | data[a + 3])
                fps = {1: 24000 / 1001, 2: 24, 3: 25, 4: 30000 / 1001, 5: 30, 6: 50, 7: 60000 / 1001, 8: 60}.get(data[a + 4] & 15)
        elif family == "avc":
            code = data[a] & 31
            picture = code in (1, 2, 5) and n > 1 and bool(data[a + 1] & 0x80)
            begins = picture or code in (6, 7, 8, 9)
            if code == 7:
                sps = avc_sps(data[a : a + n])
                fps, size = sps.get("fps") or fps, (sps.get("width"), sps.get("height"))
        else:
            code = data[a] >> 1 & 63
            picture = code <= 31 and n > 2 and bool(data[a + 2] & 0x80)
            begins = picture or 32 <= code <= 35 or code == 39
        lead = a - 4 if a >= 4 and data[a - 4] == 0 and family != "mpeg2v" else a - 3
        nodes.append({"id": k, "parent_id": -1, "depth": 0, "type": str(code), "kind": "unit", "offset": lead, "size": n + a - lead, "header_size": a - lead, "warnings": []})
        if begins and fresh:
            cur, fresh = lead, False
            frames.append(lead)
        if picture:
            if not fresh and frames and frames[-1] != cur:
                frames.append(lead)
            fresh = True
            cur = None
    if not frames:
        return nodes, [], {}
    offset = np.array(frames, np.int64)
    sizes = np.diff(np.append(offset, len(data)))
    kinds = []
    for o, s in zip(offset.tolist(), sizes.tolist(), strict=True):
        part = data[o : o + s]
        units = [part[a : a + n] for a, n in annex_b(part)]
        kinds.append(mpeg2_frame(part) if family == "mpeg2v" else avc_frame(units) if family == "avc" else hevc_frame(units))
    rate = fps or FALLBACK
    step = round(90_000 / rate)
    n = len(offset)
    track = {"track": 1, "kind": "video", "codec": family, "timescale": 90_000, "duration": step * n, "width": size[0], "height": size[1], "channels": None, "sample_rate": None}
    return nodes, [track], {1: {"offset": offset, "size": sizes, "dts": np.arange(n) * step, "duration": np.full(n, step), "cto": None, "key": np.array([bool(f["rap"]) for f in kinds]), "letter": np.array([f["kind"] for f in kinds], object)}}
