"""Frames of audio streams: headers of ADTS, MPEG audio and (E-)AC-3, configurations, and framing across packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from .es import Bits
from .files import uint

# Sample rates by index, bit rates by layer, and frame sizes.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MPEG_RATES = (44100, 48000, 32000)
MPEG_KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
AC3_RATES = (48000, 44100, 32000)
AC3_KBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


class Frame(NamedTuple):
    offset: int
    size: int
    samples: int
    rate: int
    channels: int


Header = Callable[[bytes, int], tuple[int, int, int, int] | None]


def adts(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(size, samples, rate, channels) of the frame whose header is at ``at``, or None."""
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return None
    index, size = data[at + 2] >> 2 & 15, (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    if index >= len(AAC_RATES) or size < 7:
        return None
    return size, 1024 * ((data[at + 6] & 3) + 1), AAC_RATES[index], (data[at + 2] & 1) << 2 | data[at + 3] >> 6


def mpeg_audio(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    rate, kbits = data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if version == 1 or layer == 4 or rate == 3 or kbits in (0, 15):
        return None
    low = version != 3
    hz = MPEG_RATES[rate] >> (0 if not low else 1 if version == 2 else 2)
    bits = MPEG_KBITS[2 if low else 1, min(layer, 2) if low else layer][kbits] * 1000
    padding = data[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    size = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
    return size, samples, hz, 1 if data[at + 3] >> 6 == 3 else 2


def ac3(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """AC-3, and independent or dependent substreams of E-AC-3 (those add no samples)."""
    if at + 7 > len(data) or data[at : at + 2] != b"\x0b\x77":
        return None
    if data[at + 5] >> 3 > 10:
        kind, size = data[at + 2] >> 6, (((data[at + 2] & 7) << 8 | data[at + 3]) + 1) * 2
        rate, blocks = data[at + 4] >> 6, (1, 2, 3, 6)[data[at + 4] >> 4 & 3]
        hz = AC3_RATES[rate] if rate < 3 else AC3_RATES[min(2, data[at + 4] >> 4 & 3)] // 2
        return size, 0 if kind == 1 else 256 * (blocks if rate < 3 else 6), hz, AC3_CHANNELS[data[at + 4] >> 1 & 7] + (data[at + 4] & 1)
    rate, code = data[at + 4] >> 6, data[at + 4] & 63
    if rate == 3 or code >= 38:
        return None
    kbits = AC3_KBITS[code >> 1]
    size = kbits * 4 if rate == 0 else kbits * 6 if rate == 2 else 2 * (kbits * 96000 // 44100 + (code & 1))
    mode = data[at + 6] >> 5
    bits = Bits(data[at + 6 : at + 9].ljust(3, b"\0"))
    bits.at = 3 + (2 if mode & 1 and mode != 1 else 0) + (2 if mode & 4 else 0) + (2 if mode == 2 else 0)
    return size, 1536, AC3_RATES[rate], AC3_CHANNELS[mode] + bits.u(1)


HEADERS: dict[str, Header] = {"aac": adts, "mp3": mpeg_audio, "ac3": ac3, "eac3": ac3}


class Framer:
    """Frames of one stream out of the payloads of its packets, with the place in the file where each begins.

    A header counts where the one behind its frame fits too, or nothing is there yet; what is no frame is passed over.
    """

    def __init__(self, codec: str):
        self.header = HEADERS[codec]
        self.data, self._places = b"", []  # (place in data, place in the file)
        self.lost = 0

    def feed(self, payload: bytes, offset: int) -> Iterator[Frame]:
        self._places.append((len(self.data), offset))
        self.data += payload
        yield from self._cut(False)

    def finish(self) -> Iterator[Frame]:
        yield from self._cut(True)
        self.lost += len(self.data)
        self.data = b""

    def _cut(self, last: bool) -> Iterator[Frame]:
        at = 0
        while at < len(self.data):
            found = self.header(self.data, at)
            if found is None:
                if not last and len(self.data) - at < 9:
                    break
                at, self.lost = at + 1, self.lost + 1
                continue
            end = at + found[0]
            if end > len(self.data) or not last and end + 9 > len(self.data):
                if last:
                    at, self.lost = at + 1, self.lost + 1
                    continue
                break
            if end + 9 <= len(self.data) and self.header(self.data, end) is None:
                at, self.lost = at + 1, self.lost + 1
                continue
            yield Frame(self._place(at), *found)
            at = end
        if at:
            keep = [(p - at, o) for p, o in self._places]
            first = max((k for k, (p, _) in enumerate(keep) if p <= 0), default=0)
            self._places = keep[first:]
            self.data = self.data[at:]

    def _place(self, at: int) -> int:
        p, o = next((p, o) for p, o in reversed(self._places) if p <= at)
        return o + at - p


def adts_header(size: int, rate: int, channels: int, profile: int = 2) -> bytes:
    """The ADTS header of a raw AAC frame of ``size`` bytes."""
    n, index = size + 7, AAC_RATES.index(rate)
    return bytes([0xFF, 0xF1, (profile - 1) << 6 | index << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC])


def audio_specific_config(data: bytes) -> dict:
    """Object type, rates and channels of an AAC configuration, with what it says of spectral band replication."""
    out: dict = {}
    try:
        r = Bits(data)
        r.data = data  # no emulation prevention here
        kind = lambda: 32 + r.u(6) if (k := r.u(5)) == 31 else k
        rate = lambda: r.u(24) if (k := r.u(4)) == 15 else AAC_RATES[k] if k < len(AAC_RATES) else None
        out["object_type"], out["sample_rate"], c = kind(), rate(), r.u(4)
        out["channels"] = {7: 8, 11: 7, 12: 8, 14: 8}.get(c, c)
        if out["object_type"] in (5, 29):
            out["extension"], out["extension_rate"] = out["object_type"], rate()
            out["object_type"] = kind()
        elif len(data) * 8 - r.at >= 24:
            r.u(3)
            if r.u(11) == 0x2B7 and kind() == 5 and r.u(1):
                out["extension"], out["extension_rate"] = 5, rate()
    except (EOFError, IndexError):
        out["cut"] = True
    return out


def opus_head(data: bytes) -> dict:
    """Channels, samples to skip and rate of an Opus configuration, of an Ogg stream or of MP4."""
    little = data[:8] == b"OpusHead"
    b = data[8:] if little else data
    return {"channels": b[1], "skip": uint(b, 2, 2, little), "sample_rate": uint(b, 4, 4, little)} if len(b) >= 8 else {}


def flac_info(data: bytes) -> dict:
    """Rate, channels, bits and samples of a FLAC stream's first block."""
    b = data[data.find(b"fLaC") + 8 :] if b"fLaC" in data[:64] else data
    if len(b) < 18:
        return {}
    word = uint(b, 10, 8)
    return {"sample_rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1}
