"""MPEG transport streams: layout, packets, tables, and PES packets as samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.media import _MPEG
from .files import WINDOW, Range, uint

SYNC = 0x47
#: Stream types of the programme map.
TYPES = {0x01: ("video", "mpeg1v"), 0x02: ("video", "mpeg2v"), 0x03: ("audio", "mp3"), 0x04: ("audio", "mp3"), 0x0F: ("audio", "aac"), 0x11: ("audio", "latm"), 0x1B: ("video", "avc"), 0x24: ("video", "hevc"), 0x81: ("audio", "ac3"), 0x87: ("audio", "eac3"), 0x86: ("other", "scte35"), 0x06: ("other", "private")}


def layout(head: bytes) -> tuple[int, int] | None:
    """(size of a packet, place of the first sync byte) by the periodicity of sync bytes (S13); 188 wins ties."""
    data = np.frombuffer(head, np.uint8)
    best = None
    for at in np.flatnonzero(data[: 204 * 2 + 4] == SYNC).tolist():
        for size in (188, 192, 204):
            on = data[at::size][:64] == SYNC
            n = int(on.argmin()) if not on.all() else len(on)
            if n < len(on) and n < 8 or n < 2:
                continue
            if best is None or n > best[0] or n == best[0] and best[1] != 188 and size == 188:
                best = (n, size, at)
    return (best[1], best[2]) if best else None


def probe(head: bytes, size: int) -> int:
    found = layout(head[: 64 << 10])
    return 90 if found and len(head) >= 188 * 3 else 40 if found else 0


def packets(source: Range, size: int, start: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("packets", offsets, rows of 188 bytes) or ("lost", [from, to], -), in file order.

    Where a sync byte is missing, reading goes on at the next place with three in a row (S14).
    """
    at = start
    while at + 188 <= source.size:
        data = np.frombuffer(source.read(at, WINDOW // size * size + 188), np.uint8)
        n = (len(data) - 188) // size + 1
        rows = np.lib.stride_tricks.sliding_window_view(data, 188)[: (n - 1) * size + 1 : size]
        good = rows[:, 0] == SYNC
        m = n if good.all() else int(good.argmin())
        if m:
            yield "packets", at + np.arange(m) * size, rows[:m]
            at += m * size
            continue
        begin = at
        at += 1
        while True:
            data = np.frombuffer(source.read(at, WINDOW + 2 * size + 1), np.uint8)
            if not len(data):
                at = source.size
                break
            pad = np.concatenate([data, np.full(2 * size, SYNC, np.uint8)]) if at + len(data) >= source.size else data
            span = len(pad) - 2 * size
            hit = np.flatnonzero((pad[:span] == SYNC) & (pad[size : size + span] == SYNC) & (pad[2 * size : 2 * size + span] == SYNC))
            if len(hit):
                at += int(hit[0])
                break
            at += span
        yield "lost", np.array([begin, at]), np.zeros((0, 188), np.uint8)


def crc_ok(section: bytes) -> bool:
    crc = 0xFFFFFFFF
    for b in section:
        crc = (crc << 8 & 0xFFFFFFFF) ^ int(_MPEG[crc >> 24 ^ b])
    return crc == 0


def timestamp(b: bytes, at: int) -> int:
    return (b[at] >> 1 & 7) << 30 | b[at + 1] << 22 | b[at + 2] >> 1 << 15 | b[at + 3] << 7 | b[at + 4] >> 1


class _Sections:
    """Sections of one PID out of the payloads of its packets."""

    def __init__(self):
        self.data = b""

    def add(self, payload: bytes, start: bool) -> list[bytes]:
        if start:
            pointer = payload[0] if payload else 0
            done = self._cut(payload[1 : 1 + pointer]) if self.data else []
            self.data = b""
            return done + self._cut(payload[1 + pointer :])
        return self._cut(payload) if self.data else []

    def _cut(self, more: bytes) -> list[bytes]:
        self.data += more
        out = []
        while len(self.data) >= 3 and self.data[0] != 0xFF:
            n = 3 + (uint(self.data, 1, 2) & 0xFFF)
            if len(self.data) < n:
                return out
            out.append(self.data[:n])
            self.data = self.data[n:]
        if self.data[:1] == b"\xff":
            self.data = b""
        return out


def read(source: Range, every: bool = True) -> dict[str, list[dict]]:
    """packets (pid, i, counter, payload, discontinuity, start, offset, pcr), sections, tracks, pes and lost ranges of a file.

    ``pes`` has a row by PES packet: pid, offset, size of its payload, pts, dts, random access, and how it ended
    (whole, truncated, excess); payload before a first start is counted as orphan by PID. Without ``every`` the rows of
    packets are left out.
    """
    found = layout(source.read(0, 64 << 10))
    out: dict[str, list[dict]] = {"packets": [], "sections": [], "tracks": [], "pes": [], "lost": [], "orphans": []}
    if not found:
        return out
    size, start = found
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    assembling: dict[int, _Sections] = {0: _Sections()}
    seen: dict[tuple[int, int, int], bytes] = {}
    open_pes: dict[int, dict] = {}
    orphans: dict[int, int] = {}
    i = 0

    def close(pid: int) -> None:
        p = open_pes.pop(pid, None)
        if not p:
            return
        head = bytes(p.pop("head"))
        got, flags = p.pop("got"), head[7] if len(head) >= 9 and head[6] >> 6 == 2 else 0
        skip = 9 + head[8] if flags or len(head) >= 9 and head[6] >> 6 == 2 else 6
        pts = timestamp(head, 9) if flags & 0x80 and len(head) >= 14 else None
        dts = timestamp(head, 14) if flags & 0x40 and len(head) >= 19 else pts
        declared = uint(head, 4, 2)
        end = "whole" if not declared or got == declared + 6 else "truncated" if got < declared + 6 else "excess"
        out["pes"].append(p | {"size": max(0, (min(got, declared + 6) if declared else got) - skip), "pts": pts, "dts": dts, "ended": end})

    for kind, offsets, rows in packets(source, size, start):
        if kind == "lost":
            out["lost"].append({"offset": int(offsets[0]), "size": int(offsets[1] - offsets[0])})
            continue
        pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
        for k in range(len(rows)):
            pid, row = int(pids[k]), rows[k]
            control, at, pcr, access, jump = int(row[3]) >> 4 & 3, 4, None, False, False
            if control & 2:
                n = int(row[4])
                at = 5 + n
                if n:
                    jump, access = bool(row[5] & 0x80), bool(row[5] & 0x40)
                    if row[5] & 0x10 and n >= 7:
                        b = row[6:12].tobytes()
                        pcr = (uint(b, 0, 4) << 1 | b[4] >> 7) * 300 + ((b[4] & 1) << 8 | b[5])
            begins, payload = bool(row[1] & 0x40), bytes(row[at:]) if control & 1 and at < 188 else b""
            if every:
                out["packets"].append({"pid": pid, "i": i, "counter": int(row[3]) & 15, "payload": bool(control & 1), "discontinuity": jump, "start": begins, "error": bool(row[1] & 0x80), "scrambled": bool(row[3] & 0xC0), "offset": int(offsets[k]), "pcr": pcr})
            i += 1
            if row[1] & 0x80 or not payload:
                continue
            if pid in assembling:
                for section in assembling[pid].add(payload, begins):
                    _section(section, pid, i - 1, programs, streams, assembling, seen, out)
            elif pid in streams:
                if begins and payload[:3] == b"\0\0\1":
                    close(pid)
                    open_pes[pid] = {"pid": pid, "i": i - 1, "offset": int(offsets[k]) + at, "head": bytearray(payload[:64]), "got": len(payload), "access": access}
                elif pid in open_pes:
                    p = open_pes[pid]
                    if len(p["head"]) < 64:
                        p["head"] += payload[: 64 - len(p["head"])]
                    p["got"] += len(payload)
                else:
                    orphans[pid] = orphans.get(pid, 0) + len(payload)
    for pid in list(open_pes):
        close(pid)
    out["tracks"] = [{"track": pid, "kind": TYPES.get(t, ("other", None))[0], "codec": TYPES.get(t, ("other", f"0x{t:02x}"))[1], "timescale": 90_000} for pid, t in streams.items()]
    out["orphans"] = [{"pid": pid, "bytes": n} for pid, n in orphans.items()]
    return out


def _section(section: bytes, pid: int, i: int, programs: dict, streams: dict, assembling: dict, seen: dict, out: dict) -> None:
    if len(section) < 12 or not section[1] & 0x80:
        return
    table, ext, version, nth = section[0], uint(section, 3, 2), section[5] >> 1 & 31, section[6]
    ok = crc_ok(section)
    new = seen.get((pid, table, ext << 8 | nth)) != section  # one equal to that before says nothing
    seen[pid, table, ext << 8 | nth] = section
    if new:
        out["sections"].append({"pid": pid, "table": table, "ext": ext, "version": version, "i": i, "body": section, "ok": ok})
    if not ok or not new:
        return
    end = len(section) - 4
    if table == 0:
        for p in range(8, end - 3, 4):
            number, own = uint(section, p, 2), uint(section, p + 2, 2) & 0x1FFF
            if number:
                programs[number] = own
                assembling.setdefault(own, _Sections())
    elif table == 2:
        p = 12 + (uint(section, 10, 2) & 0xFFF)
        while p + 5 <= end:
            streams.setdefault(uint(section, p + 1, 2) & 0x1FFF, section[p])
            p += 5 + (uint(section, p + 3, 2) & 0xFFF)
