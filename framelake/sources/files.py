"""Files as tables of paths, and byte ranges of them, local, on any file system that Arrow knows, or by HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.media import natural_key

# Extensions of media files, block and window sizes, and limits of HTTP reads.
EXTENSIONS = ("mp4", "m4v", "m4a", "mov", "3gp", "mkv", "webm", "mka", "ts", "m2ts", "mts", "avi", "wav", "flv", "h264", "264", "h265", "265", "hevc", "m2v")
BLOCK, CACHE, WINDOW = 64 << 10, 96 << 20, 4 << 20
RETRIES, WHOLE = 3, 64 << 20


def listing(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length) of the media files of a folder in natural order; hidden files and folders are left out.

    Contents aren't read: the listing's columns are those of the file system.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    base = F.substring_index("path", "/", -1)
    ext = F.lower(F.substring_index(base, ".", -1))
    inside = F.expr(f"substring(path, length('{folder.rstrip('/')}') + 1)") if "://" in folder else F.col("path")
    shown = ~base.startswith(".") & ~F.regexp_replace(inside, "^[a-z]+:/*", "").rlike(r"/\.")
    return files.where(ext.isin(*extensions) & shown).orderBy(natural_key(F.col("path")))


class Range:
    """A file as blocks that are kept while there is room; long reads pass by the cache."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._file = system.open_input_file(at)
        self.size = self._file.size()
        self._blocks: OrderedDict[int, bytes] = OrderedDict()

    def _raw(self, offset: int, length: int) -> bytes:
        return self._file.read_at(max(0, min(length, self.size - offset)), offset)

    def read(self, offset: int, length: int) -> bytes:
        """Bytes from ``offset`` on, fewer at the end."""
        length = max(0, min(length, self.size - offset))
        if length >= 16 * BLOCK:
            return self._raw(offset, length)
        parts = []
        for block in range(offset // BLOCK, (offset + length - 1) // BLOCK + 1) if length else ():
            if block not in self._blocks:
                self._blocks[block] = self._raw(block * BLOCK, BLOCK)
                if len(self._blocks) * BLOCK > CACHE:
                    self._blocks.popitem(last=False)
            self._blocks.move_to_end(block)
            parts.append(self._blocks[block])
        return b"".join(parts)[offset % BLOCK : offset % BLOCK + length]

    def windows(self, start: int = 0, size: int = WINDOW):
        """(offset, bytes) one after another."""
        for at in range(start, self.size, size):
            yield at, self._raw(at, size)

    def close(self) -> None:
        self._file.close()


class HttpRange(Range):
    """The same over HTTP (S4): the size by a range of one byte, or by HEAD; busy servers are asked again, waiting twice
    as long each time; a server without ranges is read whole up to ``WHOLE`` bytes."""

    def __init__(self, url: str, wait: float = 0.25):
        self.url, self._wait, self._whole = url, wait, None
        self._blocks = OrderedDict()
        status, headers, body = self._ask({"Range": "bytes=0-0"})
        if status == 206 and "/" in headers.get("Content-Range", ""):
            self.size = int(headers["Content-Range"].rsplit("/", 1)[1])
        elif status == 200:
            size = int(headers.get("Content-Length") or self._ask({}, "HEAD")[1].get("Content-Length") or len(body))
            if size > WHOLE:
                raise OSError("the server has no ranges and the file is too large to be read whole")
            self._whole, self.size = body, len(body)
        else:
            raise OSError(f"status {status}")

    def _ask(self, headers: dict[str, str], method: str = "GET") -> tuple[int, dict, bytes]:
        for again in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers, method=method), timeout=30) as r:
                    return r.status, dict(r.headers), r.read(WHOLE + 1)
            except urllib.error.HTTPError as e:
                if again == RETRIES or e.code != 429 and e.code < 500:
                    raise
            time.sleep(self._wait * 2**again)
        raise OSError("unreachable")

    def _raw(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        if self._whole is not None or not length:
            return (self._whole or b"")[offset : offset + length]
        status, headers, body = self._ask({"Range": f"bytes={offset}-{offset + length - 1}"})
        if status != 206 or not headers.get("Content-Range", "").startswith(f"bytes {offset}-"):
            raise OSError("the server sent another range")
        return body

    def close(self) -> None:
        return


def open_range(path: str) -> Range:
    return HttpRange(path) if path.startswith(("http://", "https://")) else Range(path)


def uint(data: bytes, at: int, size: int, little: bool = False) -> int:
    return int.from_bytes(data[at : at + size], "little" if little else "big")


def table(data: bytes, at: int, count: int, columns: str) -> np.ndarray:
    """``count`` rows of fixed width; ``columns`` as numpy types."""
    kind = np.dtype(columns)
    count = max(0, min(count, (len(data) - at) // kind.itemsize))
    return np.frombuffer(data, kind, count, at)
