"""Benchmark decontamination over a distributed positional inverted index.

The index is made of the training texts alone and serves any test set. It is partitioned by documents: each row is a
shard of about ``SHARD`` bytes of text with, for every distinct word, its bytes and the sorted positions of its
occurrences (one position is left free between documents, so that no phrase runs over an edge). Words are told apart
by their bytes, in a shard as between test and training texts.

A window of test words is dropped where a shard lacks any of them; otherwise the shortest posting list gives the
candidate starts, which are intersected with the offset-adjusted lists of the other words, shorter lists first. A
document lies in one shard, so what is found is a row per document with any, and no document or passage, however
frequent, gathers rows in one task. Test sets go to the shards in parts of bounded size; what the parts find is
summed up by document in the same way for one part as for many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textnum as tn
from .store import Scratch

WINDOW = 10
SHARD = 4 << 20
#: Bytes of the index that a task of Spark writes or reads at once.
BLOCK = 4 << 20
#: Bytes of test texts that are broadcast at once.
PASS_BYTES = 32 << 20
#: Candidate places that are intersected at once.
PLACES = 1 << 20
#: Words by which the terms of a proximity match may lie further apart than in the test text.
SLOP = 5

INDEX = "doc_ids binary, first binary, n_words binary, seed int, words binary, edges binary, offsets binary, positions binary"
FOUND = "shard long, place int, spans array<struct<start:long,end:long>>, item_ids array<string>, near_ids array<string>"


class Items:
    """Test texts as term numbers; ``start`` and ``item`` by window, by length of the windows."""

    def __init__(self, rows: list[tuple[str, str]]):
        kept = [(i, t.encode()) for i, t in rows if t]
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in kept])]).astype(np.int64)
        words = tn.Words(np.frombuffer(b"".join(t for _, t in kept), np.uint8), offsets, tn.ALNUM)
        first, number, _ = tn.numbered(words.data, words.start, words.end)
        self.number = number.astype(np.int32)
        self.data, self.start, self.end = words.data, words.start[first], words.end[first]
        self.ids = np.array([i for i, _ in kept], object)
        starts, items = {}, {}
        for k, n in enumerate(words.count):
            if n:
                m = min(int(n), WINDOW)
                starts.setdefault(m, []).append(words.first[k] + np.arange(n - m + 1))
                items.setdefault(m, []).append(np.full(n - m + 1, k))
        self.windows = [(m, np.concatenate(starts[m]), np.concatenate(items[m])) for m in sorted(starts)]
        self._hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_hash(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the terms, their numbers) by the hash that a shard uses."""
        if seed not in self._hashes:
            h = tn.hashes(self.data, self.start, self.end, seed)
            order = np.argsort(h, kind="stable")
            self._hashes[seed] = h[order], order
        return self._hashes[seed]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in tn.chunks(batch.column(1), SHARD):
            words = tn.Words(data, offsets, tn.ALNUM)
            n = words.count
            pos = np.arange(len(words.start), dtype=np.int64) + np.repeat(np.arange(hi - lo), n)
            first, number, seed = tn.numbered(words.data, words.start, words.end)
            order = np.argsort(number.astype(np.int32), kind="stable")
            start, end = words.start[first], words.end[first]
            edges = np.concatenate([[0], np.cumsum(end - start)])
            parts = (
                ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64),
                (words.first[:-1] + np.arange(hi - lo)).astype(np.int64),
                n.astype(np.int64),
                words.data[np.repeat(start - edges[:-1], end - start) + np.arange(edges[-1])],
                edges.astype(np.int32),
                np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(first)))]).astype(np.int32),
                pos[order].astype(np.int32),
            )
            packed = [pa.array([x.tobytes()], pa.binary()) for x in parts]
            yield pa.RecordBatch.from_arrays([*packed[:3], pa.array([seed], pa.int32()), *packed[3:]], names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, scratch: Scratch, name: str = "index") -> DataFrame:
    """The positional index of ``docs`` (doc_id, text) as a table, one row per shard, which ``shard`` numbers.

    Shards take megabytes: each is a row group of its own, uncompressed (compression saves a sixteenth of its bytes),
    so that neither writing nor reading holds a task's whole part, nor buffers for it outside of the heap.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return scratch.table(docs.mapInArrow(_index, INDEX).select(F.monotonically_increasing_id().alias("shard"), "*"), name, codec="uncompressed", block=BLOCK)


class _Shard:
    """Posting lists of those terms of a shard that are test terms."""

    def __init__(self, row: dict, items: Items):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.first, self.n_words = (read(c, np.int64) for c in ("first", "n_words"))
        words, edges, offsets = read("words", np.uint8), read("edges", np.int32).astype(np.int64), read("offsets", np.int32)
        terms = tn.hashes(words, edges[:-1], edges[1:], row["seed"])
        hashes, number = items.by_hash(row["seed"])
        at = np.searchsorted(hashes, terms)
        at[at == len(hashes)] = 0
        own = np.flatnonzero(hashes[at] == terms) if len(hashes) else np.zeros(0, np.int64)
        k = number[at[own]] if len(own) else own
        # test terms of one hash stand side by side: a shard's term is one of them or none
        again, left = [], np.arange(len(own))
        step = 0
        while len(left):
            ok = tn.same_bytes(words, edges[own[left]], edges[own[left] + 1], items.data, items.start[k[left]], items.end[k[left]])
            again.append(left[ok])
            step += 1
            left = left[~ok]
            follow = at[own[left]] + step
            inside = follow < len(hashes)
            left, follow = left[inside], follow[inside]
            same = hashes[follow] == terms[own[left]]
            left, follow = left[same], follow[same]
            k[left] = number[follow]
        ok = np.concatenate(again) if again else np.zeros(0, np.int64)
        ok = ok[np.argsort(k[ok])]
        own, k = own[ok], k[ok]
        size = (offsets[own + 1] - offsets[own]).astype(np.int64)
        self.count = np.zeros(len(items.start) + 1, np.int64)
        self.count[k] = size
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        total = np.cumsum(size)
        self.pos = read("positions", np.int32)[np.repeat(offsets[own] - (total - size), size) + np.arange(total[-1] if len(total) else 0)].astype(np.int64)
        # one sorted key per posting, by term and position
        self.keys = (np.repeat(k.astype(np.int64), size) << 32) | self.pos

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting in [low, high]."""
        term, low = term.astype(np.int64) << 32, np.maximum(low, 0)
        at = np.searchsorted(self.keys, term | low)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= (term | np.maximum(high, 0))[found]
        return found & (high >= 0)

    def live(self, length: int, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Windows all of whose terms occur here."""
        lacks = np.concatenate([[0], np.cumsum(self.count[number] == 0)])
        return np.flatnonzero(lacks[start + length] == lacks[start])

    def search(self, length: int, windows: np.ndarray, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start) of exact matches, and (window, place of the rarest term) of proximity matches, by slices of bounded size."""
        counts = self.count[windows]
        order = np.argsort(counts, axis=1, kind="stable")
        rare = windows[np.arange(len(windows)), order[:, 0]]
        # a window whose rarest term has many postings takes several slices
        job = np.repeat(np.arange(len(windows)), -(-self.count[rare] // PLACES))
        nth = np.arange(len(job)) - np.searchsorted(job, job)
        size = np.minimum(self.count[rare[job]] - nth * PLACES, PLACES)
        slice_of = np.cumsum(size) // PLACES
        for s in np.unique(slice_of):
            part = np.flatnonzero(slice_of == s)
            m = size[part]
            row = np.repeat(job[part], m)
            begin = self.begin[rare[job[part]]] + nth[part] * PLACES
            place = self.pos[np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            near_row, near_place = row, place
            start = place - order[row, 0]
            keep = start >= 0
            row, start = row[keep], start[keep]
            for j in range(1, length):
                if not len(row):
                    break
                off = order[row, j]
                ok = self.holds(windows[row, off], start + off, start + off)
                row, start = row[ok], start[ok]
            if slop is None:
                near_row = near_place = row[:0]
            doc = np.searchsorted(self.first, near_place, "right") - 1
            lo, hi = self.first[doc], self.first[doc] + self.n_words[doc] - 1  # a match keeps to its document
            near = lambda k, at, within: self.holds(windows[near_row, k], np.maximum(at - within, lo), np.minimum(at + within, hi))  # noqa: E731, B023
            for j in range(1, length):  # seen from the rarest term, the others are at most twice as far off
                if not len(near_row):
                    break
                ok = near(order[near_row, j], near_place + order[near_row, j] - order[near_row, 0], 2 * (slop or 0))
                near_row, near_place, lo, hi = near_row[ok], near_place[ok], lo[ok], hi[ok]
            fits = np.zeros(len(near_row), bool)
            for shift in range(-(slop or 0), (slop or 0) + 1 if len(near_row) else -(slop or 0)):
                begin = near_place - order[near_row, 0] + shift
                every = np.ones(len(near_row), bool)
                for k in range(length):
                    every &= near(np.full(len(near_row), k), begin + k, slop)
                fits |= every
            near_row, near_place = near_row[fits], near_place[fits]
            yield row, start, near_row, near_place


def _search(broadcast, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = broadcast.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: v.as_py() if c in ("seed", "shard") else v.as_buffer() for c, v in row.items()}
                yield _found(row["shard"], _Shard(row, items), items, slop)

    return run


def _found(number: int, shard: _Shard, items: Items, slop: int | None) -> pa.RecordBatch:
    size = int(shard.first[-1] + shard.n_words[-1]) + 2 if len(shard.first) else 2
    edge = np.zeros(size, np.int64)
    pairs, near = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for length, starts, item in items.windows:
        live = shard.live(length, starts, items.number)
        if not len(live):
            continue
        windows = items.number[starts[live][:, None] + np.arange(length)]
        for w, start, v, place in shard.search(length, windows, slop):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
            pairs.append(np.unique(np.stack([np.searchsorted(shard.first, start, "right") - 1, item[live[w]]]), axis=1))
            near.append(np.unique(np.stack([np.searchsorted(shard.first, place, "right") - 1, item[live[v]]]), axis=1))
    hit = np.cumsum(edge) > 0
    flips = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    begin, end = flips[::2], flips[1::2]  # a free position between documents keeps spans apart
    doc = np.searchsorted(shard.first, begin, "right") - 1
    pairs, near = np.concatenate(pairs, axis=1), np.concatenate(near, axis=1)
    docs = np.unique(np.concatenate([doc, pairs[0], near[0]])).astype(np.int64)

    def lists(found: np.ndarray) -> pa.Array:
        own: dict[int, set[str]] = {}
        for x, y in zip(*found.tolist(), strict=True):
            own.setdefault(x, set()).add(items.ids[y])
        return pa.array([sorted(own.get(x, ())) for x in docs.tolist()], pa.list_(pa.string()))

    base = shard.first[doc] if len(doc) else begin
    at = np.searchsorted(doc, np.append(docs, len(shard.first))).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(docs), number, np.int64)), pa.array(docs.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), both), lists(pairs), lists(near)],
        names=["shard", "place", "spans", "item_ids", "near_ids"],
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, ids, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            ids, n = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), shard, np.int64)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(n)], names=["shard", "place", "doc_id", "n_words"]
            )


#: Spans that touch or overlap as one.
_JOINED = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
    if(size(a) > 0 and element_at(a, -1).end >= x.start,
       concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"""


def search(index: DataFrame, items: DataFrame, scratch: Scratch, slop: int | None = SLOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """What :func:`find_items` gives, over an index that :func:`build_index` made."""
    send = index.sparkSession.sparkContext.broadcast
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-total // pass_bytes))
    found = None
    for k in range(parts):
        own = send(Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]))
        part = scratch.table(index.drop("doc_ids").mapInArrow(_search(own, slop), FOUND), f"found-{k}")
        own.unpersist()
        found = part if found is None else found.union(part)
    names = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "near_ids")}
    found = found.groupBy("shard", "place").agg(F.expr(_JOINED).alias("spans"), *names.values())
    every = index.select("shard", "doc_ids", "n_words").mapInArrow(_documents, "shard long, place int, doc_id long, n_words long")
    out = every.join(found.hint("merge"), ["shard", "place"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids")
    )


def find_items(docs: DataFrame, items: DataFrame, slop: int | None = SLOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its words, hit spans and the test items found in it.

    Words are maximal runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A window is 10 consecutive words
    of an item of ``items`` (item_id, text), or the whole of a shorter one. ``spans`` are the merged ranges of words
    (from 0, end exclusive) inside an occurrence of a window; ``item_ids`` names, sorted as strings, the items with
    one; ``near_ids`` those with a window that can be laid on the document so that each of its words occurs within
    ``slop`` words of its place (None: not looked for). Null and empty texts have no words; rows without doc_id and items without id
    or words take no part; equal rows each give a row, and items that share an id count as one. Extra columns are
    ignored. Test sets of more than ``pass_bytes`` are broadcast in parts, which changes no result.
    """
    scratch = Scratch(docs.sparkSession)
    return search(build_index(docs, scratch), items, scratch, slop, pass_bytes)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
