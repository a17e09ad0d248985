"""Near-duplicate detection: banded MinHash with sequential Bayesian verification.

Texts with the same words in the same order fold into one class first (an aggregate, so any number of copies is one
row). Signatures of the class representatives are cut into bands; a band's value is a bucket. In each bucket every
member is compared with the smallest and the largest member, and where components still differ with one drawn by
hash, which joins a group of near copies in linear work. Only buckets that still hold several components need more,
and there only pairs across components: members are dealt into blocks, pairs of blocks compare signatures, and only
texts that a surviving pair names are sent to be verified, so that no task holds a whole bucket and only links that
join components are emitted. A pair survives while the posterior probability that its similarity reaches the
threshold, given the matches among the hashes compared so far (uniform prior), is at least ``miss``. Survivors are
verified on their full shingle sets, links by the words themselves, and become components by contraction.

A pair at similarity exactly 0.75 shares no band with probability (1 - 0.75**5)**40 = 2e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnum as tn
from .components import connected_components
from .store import Scratch

WORDS = 5
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
#: Signature hashes compared before each pruning decision.
BATCH = 20
#: Members of a bucket that are compared as one block.
BLOCK = 512
#: Tasks that the rows of one bucket are spread over when they meet what is known of the bucket.
SPREAD = 16
#: Pairs that are verified at once.
PAIRS = 256

_mult = tn.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_A = (_mult >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_mult & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_PLACE = tn.mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(w: tn.Words, k: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: k words, or all words of a text with fewer."""
    n, total = w.count, len(w.hash)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    h = np.zeros(total, np.uint64)
    for j in range(k):
        h += padded[j : j + total] * _PLACE[j]
    h = tn.mix(h)
    out = []
    for i in range(len(n)):
        a, m = w.first[i], n[i]
        if m >= k:
            out.append(np.unique(h[a : a + m - k + 1]))
        elif m:
            parts = np.append(w.hash[a : a + m] * _PLACE[:m], _PLACE[k + m])
            out.append(tn.mix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(non-empty sets, HASHES) low 16 bits of the least value of each set under each permutation."""
    sets = [s for s in sets if len(s)]
    if not sets:
        return np.zeros((0, HASHES), np.uint16)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


def digests(words: tn.Words) -> list[bytes]:
    """By text a cryptographic digest of its words in order."""
    keep = np.zeros(len(words.data) + 1, np.int32)
    keep[words.start] += 1
    np.add.at(keep, words.end, -1)
    inside = np.cumsum(keep[:-1]) > 0
    # the place behind each word stands for the blank between words
    data = np.concatenate([words.data, np.zeros(1, np.uint8)])
    data[words.end] = 0x20 if len(words.end) else 0
    sep = np.zeros(len(data), bool)
    sep[words.end] = True
    sep[:-1] &= ~inside
    shown = np.append(inside, False) | sep
    edge = np.concatenate([[0], np.cumsum(shown)])
    size = np.concatenate([[0], np.cumsum(words.count)])
    raw = data[shown].tobytes()
    begin = [int(edge[words.start[a]]) if a < b else 0 for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    end = [int(edge[words.end[b - 1]]) if a < b else 0 for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tn.chunks(batch.column(1)):
            words = tn.Words(data, offsets)
            sets = shingle_sets(words)
            n = np.array([len(s) for s in sets], np.int64)
            sig = iter(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digests(words), pa.binary()), pa.array([next(sig).tobytes() if m else None for m in n], pa.binary())],
                names=["id", "n", "f", "sig"],
            )


def overlaps(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For texts 0 and 1, 2 and 3, ... (sizes of the shingle sets by text, shingles in common by pair), by the words themselves."""
    data, offsets = tn.buffers(column)
    words = tn.Words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    n = words.count
    _, word, _ = tn.numbered(words.data, words.start, words.end)
    none = int(word.max()) + 1 if len(word) else 0  # stands where a short text has no word
    text = np.repeat(np.arange(len(n)), n)
    left = np.repeat(words.first[1:], n) - np.arange(len(word))  # words of the text from here on
    head = np.arange(len(word)) == words.first[:-1][text]
    at = np.flatnonzero((left >= k) | head)
    short = n[text[at]] < k
    padded = np.concatenate([word, np.full(k, none)])
    shingle = padded[at]
    for j in range(1, k):
        follow = np.where(short & (j >= left[at]), none, padded[at + j])
        shingle = pd.factorize(shingle * (none + 1) + follow)[0].astype(np.int64)
    many = int(shingle.max()) + 1 if len(shingle) else 1
    key = pd.unique(text[at] * many + shingle)
    text, shingle = key // many, key % many
    size = np.bincount(text, minlength=len(n)).astype(np.int64)
    both = np.sort(text // 2 * many + shingle)
    twice = both[1:][both[1:] == both[:-1]] // many
    return size, np.bincount(twice, minlength=len(n) // 2).astype(np.int64)


def _similar(texts: pa.Array, percent: int) -> np.ndarray:
    """Of the texts 0 and 1, 2 and 3, ... which pairs are similar enough."""
    size, common = overlaps(texts)
    return (100 * common >= percent * (size[::2] + size[1::2] - common)) & (common > 0)


def _interleaved(a: pa.Array, b: pa.Array) -> pa.Array:
    n = len(a)
    return pa.concat_arrays([a, b]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                texts = [part.column(c).cast(pa.large_string()) for c in (2, 3)]
                yield part.select([0, 1]).filter(pa.array(_similar(_interleaved(*texts), percent)))

    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """By batch: the fewest matches among the hashes so far with P(similarity >= threshold) >= miss."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0  # Beta(m + 1, n - m + 1) exceeds t with the probability that Binomial(n + 1, t) <= m
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def surviving(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (x[i], y[j]) of signatures survive every batch."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (x[i[left], part] == y[j[left], part]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = tn.buffers(column)
    return data[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, HASHES)


def _prune(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.arange(batch.num_rows)
            keep = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), every, every, least)
            yield batch.select([0, 1]).take(pa.array(keep))

    return run


NAMED = "bucket long, x long, y long, id long"


def _candidates(group: pa.Table, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b of two blocks of a bucket: pairs across components that survive pruning, each only in the first
    bucket that both are in."""
    comp, n, blk = (group.column(c).to_numpy() for c in ("comp", "n", "blk"))
    x, y, band = (group.column(c)[0].as_py() for c in ("x", "y", "band"))
    sig = _matrix(group.column("sig"))
    left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        ok = (comp[part][:, None] != comp[right][None, :]) & (
            100 * np.minimum(n[part][:, None], n[right][None, :]) >= percent * np.maximum(n[part][:, None], n[right][None, :])
        )
        if x == y:
            ok &= part[:, None] < right[None, :]
        a, b = np.nonzero(ok)
        a, b = part[a], right[b]
        keep = surviving(sig, sig, a, b, least)
        a, b = a[keep], b[keep]
        earlier = (sig[a, : ROWS * band] == sig[b, : ROWS * band]).reshape(len(a), band, ROWS).all(axis=2).any(axis=1) if band else np.zeros(len(a), bool)
        found.append(np.stack([a[~earlier], b[~earlier]]))
    a, b = np.concatenate(found, axis=1)
    return a, b


def _named(least: list[int], percent: int):
    """The rows of two blocks of a bucket that some candidate names."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = _candidates(group, least, percent)
        return group.select(["bucket", "x", "y", "id"]).take(pa.array(np.unique(np.concatenate([a, b]))))

    return run


def _joining(least: list[int], percent: int):
    """Links across components between two blocks: no more than it takes to join the components."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = _candidates(group, least, percent)
        ids, comp = group.column("id").to_numpy(), group.column("comp").to_numpy()
        column = group.column("text").combine_chunks().cast(pa.large_string())
        sets = [s for _, _, data, offsets in tn.chunks(column) for s in shingle_sets(tn.Words(data, offsets))]
        root = {int(c): int(c) for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p == q:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and _similar(column.take(pa.array([i, j])), percent)[0]:
                root[p] = q
                found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return run


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that survive pruning and whose full shingle sets are similar enough.

    Joins are by sort and merge at any size: what they read grows with the corpus.
    """
    pairs = pairs.join(reps.toDF("a", "na", "sa").hint("merge"), "a").join(reps.toDF("b", "nb", "sb").hint("merge"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
    pairs = pairs.mapInArrow(_prune(least), "a long, b long")
    both = pairs.join(texts.toDF("a", "ta").hint("merge"), "a").join(texts.toDF("b", "tb").hint("merge"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long")


def _spread(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``rows`` (bucket, id, ...) with what ``about`` has of their bucket; a large bucket is dealt over SPREAD tasks."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(SPREAD)).cast("int"))
    about = about.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.join(about.hint("merge"), ["bucket", "part"]).drop("part")


def _relabelled(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` (id, component) after further ``links``; ids without a label are their own component."""
    links = scratch.table(links, f"{name}-links")
    if links.isEmpty():
        return labels
    renamed = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    again = connected_components(renamed.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch, name)
    ids = labels.union(again.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    out = ids.join(again.toDF("component", "least"), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    return scratch.table(out, f"{name}-all")


def _components(docs: DataFrame, scratch: Scratch, percent: int, miss: float) -> DataFrame:
    """(id, n, component) of texts (id, text) whose ids are unique."""
    signed = scratch.table(docs.mapInArrow(_sign, "id long, n long, f binary, sig binary"), "signed")
    least = least_matches(percent / 100, miss)

    classes = signed.where("n > 0").groupBy("f").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "classes")
    folded = classes.where("copies > 1").select("f", "rep")
    reps = signed.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    reps = scratch.table(reps.select("id", "n", "sig"), "reps")

    # the number stands in the hash, so that values of different bands don't meet
    values = [F.xxhash64(F.lit(k), F.substring("sig", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)]
    bands = reps.select("id", F.posexplode(F.array(*values)).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("band").alias("band"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).where("m > 1")
    members = scratch.table(_spread(bands.drop("band"), shared), "members")

    used = members.select("id").distinct()
    texts = scratch.table(docs.hint("merge").join(used, "id", "left_semi").select("id", "text"), "texts")

    star = members.select("id", F.explode(F.array("lo", "hi")).alias("x")).where("id <> x")
    star = star.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    links = scratch.table(_verified(star, reps, texts, least, percent), "star")
    labels = connected_components(links, scratch, "star-cc")

    # buckets of up to three members are done: all their pairs have been compared
    large = members.where("m > 3").select("bucket", "band", "id")
    placed = lambda: large.join(labels.toDF("id", "c"), "id", "left").select("bucket", "band", "id", F.coalesce("c", "id").alias("comp"))

    # once more against another member, drawn by hash in each bucket, where components differ
    drawn = F.min(F.struct(F.xxhash64("id", "bucket"), "id", "comp"))
    again = _spread(placed(), placed().groupBy("bucket").agg(drawn.alias("x"))).where("comp <> x.comp")
    again = again.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
    labels = _relabelled(labels, _verified(again, reps, texts, least, percent), scratch, "again")

    # what is left: pairs of blocks, but none within the component that has most of a bucket's members
    parts = placed().groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"), F.count("*").alias("parts"))
    parts = parts.where("parts > 1").select(
        "bucket",
        F.col("main.comp").alias("main"),
        F.ceil((F.col("m") - F.col("main.k")) / BLOCK).alias("na"),
        F.ceil(F.col("main.k") / BLOCK).alias("np"),
    )
    deal = F.xxhash64("id", F.lit(7))
    dealt = _spread(placed(), scratch.table(parts, "parts")).withColumn("active", F.col("comp") != F.col("main"))
    dealt = dealt.withColumn("blk", F.when(F.col("active"), F.pmod(deal, "na")).otherwise(F.col("na") + F.pmod(deal, "np")))
    others = F.when(F.col("active"), F.sequence(F.lit(0), F.col("na") + F.col("np") - 1)).otherwise(F.sequence(F.lit(0), F.col("na") - 1))
    dealt = dealt.select("bucket", "band", "id", "comp", "blk", F.explode(others).alias("o"))
    dealt = dealt.select("bucket", "band", "id", "comp", "blk", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"))
    dealt = dealt.join(reps.hint("merge"), "id")
    cell = ["bucket", "x", "y"]
    named = scratch.table(dealt.groupBy(*cell).applyInArrow(_named(least, percent), NAMED), "named")
    held = dealt.join(named.hint("merge"), [*cell, "id"]).join(texts.hint("merge"), "id")
    more = held.groupBy(*cell).applyInArrow(_joining(least, percent), "a long, b long").distinct()
    final = _relabelled(labels, more, scratch, "more")
    scratch.drop("texts")

    out = signed.select("id", "n", "f").join(folded, "f", "left").select(F.col("id").alias("own"), "n", F.coalesce("rep", "id").alias("id"))
    return out.join(final, "id", "left").select(F.col("own").alias("id"), "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-6) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are maximal runs of non-space bytes after lower-casing A-Z; a text's set has its distinct shingles of
    5 words, or the whole sequence as one where there are fewer. Documents are linked where
    100 * intersection >= percent * union; ``component_id`` is the least doc_id reachable. Null, empty and blank
    texts have no shingles and link with nothing. Rows without doc_id are left out. Rows that share a doc_id are one
    document: it is linked where any of its texts is, and n_shingles is that of the text with most. Other columns
    are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _components(docs.withColumnRenamed("doc_id", "id"), scratch, percent, miss)
        out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))

    texts = docs.dropDuplicates().select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
    texts = scratch.table(texts, "rows")
    found = scratch.table(_components(texts.select("id", "text"), scratch, percent, miss), "found")
    first = texts.groupBy("doc_id").agg(F.min("id").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = texts.select(F.col("id").alias("a"), "doc_id").join(first.hint("merge"), "doc_id").where("a <> b").select("a", "b")
    labels = _relabelled(found.select("id", "component"), same, scratch, "rows-cc")
    rows = texts.select("id", "doc_id").join(labels.hint("merge"), "id").join(found.select("id", "n").hint("merge"), "id")
    own = rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least.hint("merge"), "component").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
