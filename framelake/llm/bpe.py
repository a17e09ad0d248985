"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pretokens on their byte arrays (character classes and run edges, no regular expression). The
distinct pretokens of a partition are merged together: an index maps each adjacent pair to all its positions in
them, active ranks are applied in ascending order to all positions of their pair, and the lists of the pairs that a
merge creates are updated. A partition of more than ``SEGMENT`` bytes of text is taken in segments of that size,
each with an index of its own, which bounds memory. Pretokens are told apart by their bytes.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

from . import textnum as tn
from .store import with_source

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Bytes of text whose pretokens are indexed together.
SEGMENT = 8 << 20


def _classes() -> np.ndarray:
    """Classes of all code points as the tokenizers library has them, whichever Unicode version it follows."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for lo in range(0, len(kinds), 0x1000):  # by parts, which keeps the lists of characters short
        every = [c for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        for kind, name, like in ((LETTER, "L", "a"), (NUMBER, "N", "0")):
            new = {ord(c) for c in regex.findall(rf"\p{{{name}}}", text)}
            old = {c for c in every if unicodedata.category(chr(c))[0] == name}
            kinds[[*(new & old), *(c for c in new ^ old if len(split(like + chr(c))) == 1)]] = kind
    # the characters with the property White_Space
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary; ``spec`` is the parsed JSON of a tokenizers file."""

    def __init__(self, spec: dict):
        names = byte_names()
        model = spec["model"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, k in model["vocab"].items():
            self.bytes[k] = bytes(names[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token
        self.of_byte = np.zeros(256, np.int64)
        for c, b in names.items():
            self.of_byte[b] = model["vocab"][c]
        self.rank, self.made = {}, []
        for r, (x, y) in enumerate(model["merges"]):
            a, b = model["vocab"][x], model["vocab"][y]
            self.rank.setdefault(a << 32 | b, r)
            self.made.append((a, b, model["vocab"][x + y]))
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.pair_rank = np.array([self.rank[p] for p in self.pairs.tolist()], np.int64)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids by word) of the words that lie in ``data`` between ``edges``."""
        size, n = np.diff(edges), int(edges[-1])
        first = self.of_byte[data]
        inner = np.ones(n, bool)  # places with a neighbour to the right in their word
        inner[edges[1:][size > 0] - 1] = False
        after, before = np.where(inner, np.arange(1, n + 1), -1), np.full(n, -1)
        before[1:][inner[:-1]] = np.flatnonzero(inner[:-1]) if n else []
        at = np.flatnonzero(inner)
        pair = first[at] << 32 | first[at + 1]
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[k] == pair
        at, ranks = at[hit], self.pair_rank[k[hit]]
        sym = first
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        self._note(places, heap, at, ranks)
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.made[r]
            i = np.concatenate(places.pop(r))
            i = i[sym[i] == a]
            i.sort()
            i = i[np.concatenate([[True], i[1:] != i[:-1]])] if len(i) else i
            j = after[i]
            ok = (j >= 0) & (sym[j] == b)
            i, j = i[ok], j[ok]
            if a == b and len(i) > 1:  # of places that overlap in a run, every second one from its start
                new_run = np.ones(len(i), bool)
                new_run[1:] = i[1:] != j[:-1]
                head = np.flatnonzero(new_run)
                even = (np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))) % 2 == 0
                i, j = i[even], j[even]
            if not len(i):
                continue
            sym[i], sym[j] = new, -1
            k = after[j]
            after[i] = k
            has = k >= 0
            before[k[has]] = i[has]
            p = before[i]
            left = np.concatenate([i[has], p[p >= 0]])
            right = np.concatenate([k[has], i[p >= 0]])
            pair = sym[left] << 32 | sym[right]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[at] == pair
            if hit.any():
                self._note(places, heap, left[hit], self.pair_rank[at[hit]])
        kept = sym >= 0
        return sym[kept], np.diff(np.concatenate([[0], np.cumsum(kept)])[edges])

    @staticmethod
    def _note(places: dict[int, list[np.ndarray]], heap: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
        """Adds positions to the lists of their pairs' ranks; ranks that get a list become active."""
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        begin = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for r, lo, hi in zip(ranks[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
            if r in places:
                places[r].append(at[lo:hi])
            else:
                places[r] = [at[lo:hi]]
                heapq.heappush(heap, r)


class Encoder:
    """Cuts chunks of texts into pretokens and encodes them; one by Python worker."""

    def __init__(self, spec: dict):
        self.vocab = Vocabulary(spec)
        self.kinds = _classes()
        self.ascii = self.kinds[:128]

    def byte_classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kinds = self.ascii[data & 0x7F]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            b0, b1, b2, b3 = (padded[high + k] for k in range(4))
            two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
            code = np.where(two, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(three, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
            k = self.kinds[np.minimum(code, 0x10FFFF)]
            width = np.where(two, 2, np.where(three, 3, 4))
            for j in range(4):
                on = (width > j) & (high + j < len(data))
                kinds[high[on] + j] = k[on]
        return kinds

    def starts(self, data: np.ndarray, edges: np.ndarray, fixed: list[tuple[int, int]]) -> np.ndarray:
        """Where pretokens begin; none crosses one of the ascending ``edges``, and ``fixed`` ranges are one each."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self.byte_classes(data)
        on = np.empty(n, bool)
        on[0] = True
        on[1:] = kinds[1:] != kinds[:-1]
        inner = edges[edges < n]
        edge = np.zeros(n + 1, bool)
        edge[inner] = edge[n] = True
        on |= edge[:n]
        run = np.flatnonzero(on)
        stop = np.append(run[1:], n)
        gap = (kinds[run] == SPACE) & ~edge[stop]  # runs of spaces before something
        after = stop[gap]
        last = after - 1
        while len(more := np.flatnonzero((data[last] & 0xC0) == 0x80)):
            last[more] -= 1
        on[last] = True
        on[after[data[last] == 0x20]] = False
        quote = np.flatnonzero((data == 0x27) & on)
        quote = quote[quote + 1 < n]
        quote = quote[(kinds[quote + 1] == LETTER) & ~edge[quote + 1]]
        if len(quote):
            c1 = data[quote + 1]
            q2 = np.minimum(quote + 2, n - 1)
            c2 = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], data[q2], 0)
            one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
            two = ((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C))
            for mask, width in ((one, 2), (two, 3)):
                q = quote[mask]
                on[q + 1] = False
                end = q + width
                on[end[end < n]] = True
        for a, b in fixed:
            on[a:b] = False
            on[a] = True
        return np.flatnonzero(on)

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pretokens of the texts begin."""
        edges, fixed = offsets, []
        raw = None
        for token in self.vocab.special:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(token)
            while at >= 0:
                k = np.searchsorted(offsets, at, "right")
                if at + len(token) <= offsets[k]:
                    fixed.append((at, at + len(token)))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        if fixed:
            fixed.sort()
            edges = np.unique(np.concatenate([offsets, np.array(fixed).ravel()]))
        return self.starts(data, edges, fixed)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts' ids) of one chunk."""
        segment = Segment(self)
        segment.add(data, offsets, None)
        return next(segment.encoded())[1:]


def _ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of the ranges one after another, their edges)."""
    edges = np.concatenate([[0], np.cumsum(end - start)])
    return data[np.repeat(start - edges[:-1], end - start) + np.arange(edges[-1])], edges


class Known:
    """Pretokens that were merged before, with their ids: up to ``most``, of at most ``LONGEST`` bytes, told apart by their bytes."""

    LONGEST = 48

    def __init__(self, most: int):
        self.most = most
        self.hashes, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in the order of the hashes
        self.data, self.edges = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each range's pretoken, or -1."""
        out = np.full(len(h), -1)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            row = np.flatnonzero(self.hashes[k] == h)
            k = self.which[k[row]]
            ok = tn.same_bytes(data, start[row], end[row], self.data, self.edges[k], self.edges[k + 1])
            out[row[ok]] = k[ok]
        return out

    def merge(self, vocab: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`Vocabulary.merge` gives for the distinct ranges [start, end) of ``data``."""
        h = tn.hashes(data, start, end)
        k = self._find(h, data, start, end)
        old, new = np.flatnonzero(k >= 0), np.flatnonzero(k < 0)
        k = k[old]
        ids, more = vocab.merge(*_ranges(data, start[new], end[new]))
        n, begin = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        n[old], begin[old] = self.at[k + 1] - self.at[k], self.at[k]
        n[new], begin[new] = more, len(self.ids) + np.cumsum(more) - more
        edge = np.concatenate([[0], np.cumsum(n)])
        out = np.concatenate([self.ids, ids])[np.repeat(begin - edge[:-1], n) + np.arange(edge[-1])]
        size = (end - start)[new]
        kept = np.flatnonzero((size > 0) & (size <= self.LONGEST))[: self.most - len(self.hashes)]
        if len(kept):
            self._keep(h[new[kept]], *_ranges(data, start[new[kept]], end[new[kept]]), *_ranges(ids, (np.cumsum(more) - more)[kept], np.cumsum(more)[kept]))
        return out.astype(np.int64), n

    def _keep(self, h: np.ndarray, data: np.ndarray, edges: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        hashes = np.concatenate([self.hashes, h])
        which = np.concatenate([self.which, np.arange(len(self.hashes), len(hashes), dtype=np.int32)])
        order = np.argsort(hashes)
        self.hashes, self.which = hashes[order], which[order]
        self.edges, self.at = np.append(self.edges, edges[1:] + len(self.data)), np.append(self.at, at[1:] + len(self.ids))
        self.data, self.ids = np.append(self.data, data), np.append(self.ids, ids.astype(np.int32))


class Segment:
    """Chunks of texts whose distinct pretokens are merged in one index; those that are ``known`` aren't merged again."""

    def __init__(self, encoder: Encoder, known: Known | None = None):
        self.encoder, self.known = encoder, known
        self.bytes = 0
        self._chunks: list[tuple] = []
        self._words: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, own) -> None:
        """``own`` comes back beside the chunk's ids."""
        start = self.encoder.pretokens(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        first, which, _ = tn.numbered(data, start, end)
        self._words.append(_ranges(data, start[first], end[first]))
        self._chunks.append((own, which.astype(np.int32), np.searchsorted(start, offsets)))
        self.bytes += len(data)

    def encoded(self) -> Iterator[tuple]:
        """(own, ids of all texts, offsets of the texts' ids) by chunk."""
        vocab = self.encoder.vocab
        data = np.concatenate([w for w, _ in self._words])
        base = np.cumsum([0] + [len(w) for w, _ in self._words])
        start = np.concatenate([e[:-1] + b for (_, e), b in zip(self._words, base, strict=False)])
        end = np.concatenate([e[1:] + b for (_, e), b in zip(self._words, base, strict=False)])
        first, number, _ = tn.numbered(data, start, end)
        start, end = start[first], end[first]
        special = np.full(len(first), -1)
        for token, k in vocab.special.items():
            like = np.flatnonzero(end - start == len(token))
            t = np.frombuffer(token, np.uint8)
            special[like[tn.same_bytes(data, start[like], end[like], t, np.zeros(len(like), np.int64), np.full(len(like), len(t)))]] = k
        one = special >= 0
        end = np.where(one, start, end)
        ids, n = self.known.merge(vocab, data, start, end) if self.known else vocab.merge(*_ranges(data, start, end))
        ids = np.insert(ids, (np.cumsum(n) - n)[one], special[one])
        n[one] = 1
        begin, at = np.cumsum(n) - n, 0
        for (own, which, texts), (_, edges) in zip(self._chunks, self._words, strict=True):
            which = number[at : at + len(edges) - 1][which]
            at += len(edges) - 1
            count = n[which]
            edge = np.concatenate([[0], np.cumsum(count)])
            yield own, ids[np.repeat(begin[which] - edge[:-1], count) + np.arange(edge[-1])], edge[texts]


_encoders: dict[str, Encoder] = {}


def _encoder(text: str) -> Encoder:
    key = str(hash(text))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(json.loads(text))
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(columns but the last, ids, offsets of the texts' ids) by chunk of the texts in the last column."""
    segment = Segment(encoder)
    for batch in batches:
        for lo, hi, data, offsets in tn.chunks(batch.column(batch.num_columns - 1)):
            segment.add(data, offsets, _columns(batch, lo, hi, []))
            if segment.bytes >= SEGMENT:
                yield from segment.encoded()
                segment = Segment(encoder)
    if segment._chunks:
        yield from segment.encoded()


def _columns(batch: pa.RecordBatch, lo: int, hi: int, more: list[pa.Array]) -> list[pa.Array]:
    return [c.slice(lo, hi - lo) for c in batch.columns[:-1]] + more


def _packed(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, spec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids``: the ids of ``text`` as little-endian unsigned 32-bit integers.

    ``spec`` is the broadcast text of a tokenizers JSON file of a byte-level BPE (its size is fixed). Special tokens
    in a text become their ids; null counts as empty; a column that was called ``ids`` is replaced. All rows and
    other columns stay as they are.
    """
    df = df.drop(ids) if ids != text else df.withColumnRenamed(ids, text := "__text")
    kept = [c for c in df.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, out, at in encoded(batches, _encoder(spec.value)):
            yield pa.RecordBatch.from_arrays([*own, _packed(pa.binary(), at * 4, out.astype("<u4"))], names=[*kept, ids])

    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(ids, "binary")
    return with_source(df, kept, text).mapInArrow(run, schema)


def _texts(vocab: Vocabulary, packed: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of ids that stand as little-endian 32-bit integers in the bytes ``packed``."""
    k = np.frombuffer(packed.tobytes(), "<u4").astype(np.int64)
    n = vocab.length[k]
    edge = np.concatenate([[0], np.cumsum(n)])
    data = vocab.flat[np.repeat(vocab.begin[k] - edge[:-1], n) + np.arange(edge[-1])]
    try:
        return _packed(pa.binary(), edge[offsets // 4], data).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        raw = data.tobytes()
    at = edge[offsets // 4].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.string())


def decode(df: DataFrame, spec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text`` decoded from ``ids`` as :func:`encode` makes them.

    Special tokens are kept; bytes that aren't UTF-8 become U+FFFD; null ids give an empty text; unknown ids raise.
    """
    df = df.drop(text)
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _encoder(spec.value).vocab
        for batch in batches:
            for lo, hi, data, offsets in tn.chunks(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays(_columns(batch, lo, hi, [_texts(vocab, data, offsets)]), names=[*kept, text])

    schema = df.schema.add(text, "string")
    return with_source(df, kept, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, spec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` without ``text``, with the columns ``ids`` of :func:`encode` and ``decoded`` that :func:`decode` makes of them.

    Both in one pass, so that a task holds one vocabulary in one Python worker. ``decoded`` may be called as ``text``
    is; other columns of those names are replaced.
    """
    kept = [c for c in df.columns if c not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for own, out, at in encoded(batches, encoder):
            packed = np.ascontiguousarray(out.astype("<u4")).view(np.uint8)
            yield pa.RecordBatch.from_arrays([*own, _packed(pa.binary(), at * 4, packed), _texts(encoder.vocab, packed, at * 4)], names=[*kept, ids, decoded])

    own = df.select(*[f"`{c}`" for c in kept])
    return with_source(df, kept, text).mapInArrow(run, own.schema.add(ids, "binary").add(decoded, "string"))


def load_spec(spark, path: str):
    """The vocabulary file at ``path`` on the driver, broadcast (1.5 MB; it doesn't grow with the data)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
