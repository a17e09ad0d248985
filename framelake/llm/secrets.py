"""Secret scans: fixed shapes, and sliding-window entropy over candidate strings.

Assignments, access keys and long hex strings are found by pattern. Beyond them, every run of key-like characters
is a candidate; a window slides over it, the Shannon entropy of the window is kept up to date by the counts of the
character that enters and the one that leaves, and windows above the limit of the candidate's character class are
joined into spans. Candidates that match the allow-list whole, words that mark an example, and spans inside one found
by shape are not reported; what stands beside such a word is looked at like any candidate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import textnum as tn
from .store import with_source

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run is matched from its start to its end either way, so the least length can stand in these two patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_VALUE = 8

#: Characters of a window, and of one in a candidate that is shorter than that.
WINDOW, SHORT = 24, 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SHORT)
#: Least entropy of a window, in bits a character, by the class of the candidate's characters and the window; digits
#: alone never count, and neither do short runs of hex digits or of letters of one case, which words can't be told from.
LIMITS = {
    WINDOW: {"digits": math.inf, "hex": 3.0, "letters": 3.6, "cases": 3.9, "mixed": 3.7},
    SHORT: {"digits": math.inf, "hex": math.inf, "letters": math.inf, "cases": 3.6, "mixed": 3.3},
}
#: Candidates that are not secrets: identifiers and paths of words, and UUIDs.
ALLOWED = (
    r"[a-z]{1,16}(?:[-_/][a-z]{1,16})+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"/?(?:[A-Za-z][a-z]{0,15}/)+(?:[A-Za-z][a-z]{0,15})?",
)
#: Words that mark an example: they are no part of a secret, but what stands beside them may be one.
MARKS = re.compile(r"(?i)example|placeholder|changeme")

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def char_class(run: str) -> str:
    if run.isdigit():
        return "digits"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    if not run.isalpha():
        return "mixed"
    return "letters" if run[1:].islower() or run.isupper() else "cases"


def entropy_spans(run: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is ``limit`` or more."""
    if limit == math.inf or len(run) < window:
        return []
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n] if n < window else 0.0
        if i + 1 < window:
            continue
        if math.log2(window) - total / window >= limit - 1e-9:
            lo = i + 1 - window
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
        old = run[i + 1 - window]
        n = counts[old]
        counts[old] = n - 1
        total -= _NLOGN[n] - _NLOGN[n - 1]
    return out


def scan(text: str, allowed: re.Pattern) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as in ``KINDS``."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    covers, reach = [], -1
    for _, lo, hi in base:
        if hi > reach:
            covers.append((lo, hi))
            reach = hi
    more, k = [], 0
    for m in CANDIDATE.finditer(text):
        if allowed.fullmatch(m[0]):
            continue
        edges = [0, *(x for mark in MARKS.finditer(m[0]) for x in mark.span()), len(m[0])]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            run = m[0][a:b]
            window = WINDOW if b - a >= WINDOW else SHORT
            if b - a < window:
                continue
            for lo, hi in entropy_spans(run, LIMITS[window][char_class(run)], window):
                lo, hi = lo + m.start() + a, hi + m.start() + a
                while k < len(covers) and covers[k][1] < hi:
                    k += 1
                if not (k < len(covers) and covers[k][0] <= lo):
                    more.append(("entropy", lo, hi))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find_secrets(docs: DataFrame, text: str = "text", to: str = "spans", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with an array ``to`` of (kind, start, end) of secrets in ``text``; a column of that name is replaced.

    Offsets count code points, ends are exclusive. Null and empty texts have an empty array; rows are neither
    dropped nor joined, so repeated rows stay repeated, and an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != to]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(to, SPANS)])
    pattern = "|".join(f"(?:{p})" for p in allowed) or r"(?!)"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = re.compile(pattern)
        for batch in batches:
            columns = batch.columns
            for lo, hi, data, offsets in tn.chunks(columns[-1]):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(bytes(data[a:b]).decode(), fine)] for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in columns[:-1]] + [pa.array(found, arrow)], names=[*kept, to])

    return with_source(docs, kept, text).mapInArrow(run, schema)
