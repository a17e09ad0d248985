"""MP4 and QuickTime: boxes, and samples from sample tables and from fragments."""

from __future__ import annotations

import numpy as np

from .files import Range, table, uint

#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0}
#: A container larger than this is walked by its children's headers and not held.
HELD = 64 << 20


def probe(head: bytes, size: int) -> int:
    kind = head[4:8]
    return 100 if kind == b"ftyp" else 80 if kind in (b"moov", b"moof", b"styp", b"sidx") else 50 if kind in (b"mdat", b"free", b"skip", b"wide") else 0


def boxes(source: Range, lo: int = 0, hi: int | None = None, parent: int = -1, depth: int = 0, out: list | None = None) -> list[dict]:
    """All boxes in file order; media data is passed over, and what can't be a box ends its level with a warning."""
    out = [] if out is None else out
    hi = source.size if hi is None else hi
    at = lo
    while at + 8 <= hi:
        head = source.read(at, 16)
        size, header = uint(head, 0, 4), 8
        if size == 1:
            size, header = uint(head, 8, 8), 16
        elif size == 0:
            size = hi - at
        kind = head[4:8]
        warnings = []
        if size < header or at + size > hi:
            warnings.append("runs past its parent" if size >= header else "no size of a box")
            size = hi - at
        node = {"id": len(out), "parent_id": parent, "depth": depth, "type": kind.decode("latin-1"), "kind": "box", "offset": at, "size": size, "header_size": header, "warnings": warnings}
        out.append(node)
        if kind in CONTAINERS and not (warnings and size < header):
            boxes(source, at + header + CONTAINERS[kind], at + size, node["id"], depth + 1, out)
        at += size
    return out


class Tree:
    def __init__(self, source: Range):
        self.source, self.nodes = source, boxes(source)
        self._of: dict[int, list[dict]] = {}
        for n in self.nodes:
            self._of.setdefault(n["parent_id"], []).append(n)

    def children(self, node: dict | None, kind: str) -> list[dict]:
        return [n for n in self._of.get(node["id"] if node else -1, []) if n["type"] == kind]

    def child(self, node: dict | None, *path: str) -> dict | None:
        for kind in path:
            found = self.children(node, kind)
            if not found:
                return None
            node = found[0]
        return node

    def body(self, node: dict | None) -> bytes:
        return self.source.read(node["offset"] + node["header_size"], min(node["size"] - node["header_size"], HELD)) if node else b""


def _runs(body: bytes, kind: str) -> np.ndarray:
    return table(body, 8, uint(body, 4, 4), kind) if len(body) >= 8 else np.zeros(0, kind)


def track(tree: Tree, trak: dict) -> dict:
    tkhd, mdhd, hdlr = (tree.body(tree.child(trak, *p)) for p in (("tkhd",), ("mdia", "mdhd"), ("mdia", "hdlr")))
    stsd = tree.body(tree.child(trak, "mdia", "minf", "stbl", "stsd"))
    wide = tkhd[:1] == b"\x01"
    scale_at, long = (20, 8) if mdhd[:1] == b"\x01" else (12, 4)
    handler = hdlr[8:12]
    codec = stsd[12:16].decode("latin-1") if len(stsd) >= 16 else None
    video = handler == b"vide"
    return {
        "track": uint(tkhd, 20 if wide else 12, 4), "kind": {b"vide": "video", b"soun": "audio", b"text": "text", b"sbtl": "text", b"subt": "text"}.get(handler, "other"), "codec": codec, "timescale": uint(mdhd, scale_at, 4), "duration": uint(mdhd, scale_at + 4, long),
        "width": uint(stsd, 40, 2) if video and len(stsd) >= 44 else None, "height": uint(stsd, 42, 2) if video and len(stsd) >= 44 else None,
        "channels": uint(stsd, 32, 2) if handler == b"soun" and len(stsd) >= 44 else None, "sample_rate": uint(stsd, 40, 2) if handler == b"soun" and len(stsd) >= 44 else None,
    }


def table_samples(tree: Tree, trak: dict) -> dict[str, np.ndarray]:
    """Samples of a track's tables (S8): run lengths expanded, offsets and times as running sums. A table that says too
    much or too little never raises: samples without a place are left out."""
    stbl = tree.child(trak, "mdia", "minf", "stbl")
    body = lambda kind: tree.body(tree.child(stbl, kind)) if stbl else b""
    stsz, stz2 = body("stsz"), body("stz2")
    if len(stsz) >= 12:
        fixed, count = uint(stsz, 4, 4), uint(stsz, 8, 4)
        sizes = np.full(min(count, 1 << 28), fixed, np.int64) if fixed else table(stsz, 12, count, ">u4").astype(np.int64)
    elif len(stz2) >= 12:
        bits, count = stz2[7], uint(stz2, 8, 4)
        raw = np.frombuffer(stz2, np.uint8, -1, 12)
        sizes = (np.stack([raw >> 4, raw & 15], 1).ravel() if bits == 4 else raw if bits == 8 else table(stz2, 12, count, ">u2"))[:count].astype(np.int64)
    else:
        sizes = np.zeros(0, np.int64)
    chunks = _runs(body("stco"), ">u4").astype(np.int64)
    if not len(chunks):
        chunks = _runs(body("co64"), ">u8").astype(np.int64)
    stsc = _runs(body("stsc"), ">u4,>u4,>u4")
    per = np.zeros(len(chunks), np.int64)
    entry = np.zeros(len(chunks), np.int64)
    first = stsc["f0"].astype(np.int64) - 1
    for k, a in enumerate(first):  # as many as there are runs
        b = first[k + 1] if k + 1 < len(first) else len(chunks)
        per[max(0, a) : max(0, b)], entry[max(0, a) : max(0, b)] = stsc["f1"][k], stsc["f2"][k]
    total = int(min(per.sum(), len(sizes)))
    owner = np.repeat(np.arange(len(chunks)), np.minimum(per, len(sizes)))[:total]
    sizes = sizes[:total]
    end = np.cumsum(sizes)
    head = np.searchsorted(owner, np.arange(len(chunks)))
    before = np.concatenate([[0], end])[head[owner]] if total else np.zeros(0, np.int64)
    offsets = chunks[owner] + (end - sizes - before) if total else np.zeros(0, np.int64)

    def expanded(runs: np.ndarray, signed: bool = False) -> np.ndarray:
        n = np.minimum(runs["f0"].astype(np.int64), total)
        value = runs["f1"].astype(np.uint32).view(np.int32).astype(np.int64) if signed else runs["f1"].astype(np.int64)
        out = np.repeat(value, n)[:total]
        return np.concatenate([out, np.full(total - len(out), out[-1] if len(out) and not signed else 0, np.int64)])

    durations = expanded(_runs(body("stts"), ">u4,>u4"))
    ctts = tree.child(stbl, "ctts") if stbl else None
    stss = tree.child(stbl, "stss") if stbl else None
    key = None
    if stss:
        listed = _runs(tree.body(stss), ">u4").astype(np.int64) - 1
        key = np.zeros(total, bool)
        key[listed[(listed >= 0) & (listed < total)]] = True
    return {"offset": offsets, "size": sizes, "dts": np.cumsum(durations) - durations, "duration": durations, "cto": expanded(_runs(tree.body(ctts), ">u4,>u4"), True) if ctts else None, "key": key, "chunk": owner}


def fragment_samples(tree: Tree) -> dict[int, dict[str, np.ndarray]]:
    """Samples of all fragments by track (S9): what a run lacks comes from its header, then from the track's defaults."""
    defaults = {}
    for trex in tree.children(tree.child(None, "moov", "mvex"), "trex") if tree.child(None, "moov", "mvex") else []:
        b = tree.body(trex)
        defaults[uint(b, 4, 4)] = (uint(b, 12, 4), uint(b, 16, 4), uint(b, 20, 4))
    out: dict[int, dict[str, list]] = {}
    clock: dict[int, int] = {}
    for k, moof in enumerate(tree.children(None, "moof")):
        end = moof["offset"]
        for nth, traf in enumerate(tree.children(moof, "traf")):
            head = tree.body(tree.child(traf, "tfhd"))
            if len(head) < 8:
                continue
            flags, at, own = uint(head, 1, 3), 8, uint(head, 4, 4)
            duration, size, sample_flags = defaults.get(own, (0, 0, 0))
            base = moof["offset"] if flags & 0x20000 or nth == 0 else end
            if flags & 1:
                base, at = uint(head, at, 8), at + 8
            at += 4 if flags & 2 else 0
            if flags & 8:
                duration, at = uint(head, at, 4), at + 4
            if flags & 0x10:
                size, at = uint(head, at, 4), at + 4
            if flags & 0x20:
                sample_flags = uint(head, at, 4)
            tfdt = tree.body(tree.child(traf, "tfdt"))
            if tfdt:
                clock[own] = uint(tfdt, 4, 8 if tfdt[0] == 1 else 4)
            place = base
            rows = out.setdefault(own, {c: [] for c in ("offset", "size", "dts", "duration", "cto", "key", "frag")})
            for trun in tree.children(traf, "trun"):
                b = tree.body(trun)
                f, count, p = uint(b, 1, 3), uint(b, 4, 4), 8
                if f & 1:
                    place, p = base + int.from_bytes(b[p : p + 4], "big", signed=True), p + 4
                first = None
                if f & 4:
                    first, p = uint(b, p, 4), p + 4
                fields = [n for bit, n in ((0x100, "d"), (0x200, "s"), (0x400, "f"), (0x800, "c")) if f & bit]
                got = table(b, p, count, ",".join([">u4"] * len(fields))) if fields else None
                n = count if got is None else len(got)
                column = lambda c, value: got[f"f{fields.index(c)}" if len(fields) > 1 else "f0"].astype(np.int64) if c in fields and len(fields) > 1 else got.astype(np.int64) if c in fields else np.full(n, value, np.int64)  # noqa: E731, B023
                d, s, fl, c = column("d", duration), column("s", size), column("f", sample_flags), column("c", 0)
                if first is not None and n:
                    fl[0] = first
                start = clock.get(own, 0)
                rows["offset"].append(place + np.cumsum(s) - s)
                rows["size"].append(s)
                rows["dts"].append(start + np.cumsum(d) - d)
                rows["duration"].append(d)
                rows["cto"].append(c.astype(np.uint32).view(np.int32).astype(np.int64))
                rows["key"].append((fl >> 16 & 1) == 0)
                rows["frag"].append(np.full(n, k))
                place += int(s.sum())
                clock[own] = start + int(d.sum())
            end = place
    return {t: {c: np.concatenate(v) for c, v in rows.items()} for t, rows in out.items() if rows["size"]}


def read(source: Range) -> tuple[list[dict], list[dict], dict[int, dict[str, np.ndarray]]]:
    """(nodes, tracks, samples by track); fragments' samples follow those of the tables, where a missing key is one."""
    tree = Tree(source)
    tracks, samples = [], {}
    for trak in tree.children(tree.child(None, "moov"), "trak"):
        t = track(tree, trak)
        tracks.append(t)
        samples[t["track"]] = table_samples(tree, trak)
    for own, more in fragment_samples(tree).items():
        first = samples.get(own)
        if first is None or not len(first["size"]):
            samples[own] = more
            continue
        n = len(first["size"])
        first["cto"] = np.zeros(n, np.int64) if first["cto"] is None else first["cto"]
        first["key"] = np.ones(n, bool) if first["key"] is None else first["key"]
        samples[own] = {c: np.concatenate([first[c], more[c]]) for c in ("offset", "size", "dts", "duration", "cto", "key")}
    return tree.nodes, tracks, samples
