"""Language-model scores: a causal self-attention model over subword ids, beside a unigram base.

Texts are read once: subword ids and the hashes of each document's distinct words are written beside the counts of
the training fold, and everything after works on these. The base counts words over the whole fold: per-task partial
counts are summed by hash in one shuffle. The words that the fold has most of (a fixed number) are broadcast; the
others of each document meet their counts in a join, so no count table of the corpus has to fit one machine.

The model predicts the class of the next subword by one head of causal attention over a window; frequent subwords
are classes of their own, the others share classes of like frequency, within which the counts of the whole fold
decide. What the subword before says by itself is counted: how often each input is followed by each class in the whole
fold gives the table ``B`` of logits, which stays as it is. The other weights start from some steps on a small sample,
and are then trained in parallel on the whole fold: it is
dealt by hash into shards, each shard's task trains once over all its windows from the same weights, and the changes
are averaged by their windows. A text is scored in windows of ``WINDOW`` inputs
that overlap by ``OVERLAP``, so each subword and the end are scored once; windows are batched, and masks keep later
subwords and other texts out. As inputs are embeddings of a small table, queries, keys and values are looked up.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bpe, textnum as tn
from .store import Scratch

#: Words whose counts are broadcast.
HOT = 1 << 17
#: By so many first bits of a hash its place among the broadcast ones is looked up.
TOP = 18
#: Bytes of text whose distinct pretokens are merged in one index.
SEGMENT = 16 << 20
#: Pretokens that a worker keeps the ids of, from one segment or task to the next.
KNOWN = 1 << 19
#: Distinct words that a task gathers before it sends them on.
GATHER = 1 << 19
WINDOW, OVERLAP = 32, 8
STRIDE = WINDOW - OVERLAP
WIDTH = 16
#: Classes: subwords of their own, and shared ones; inputs: subwords with an embedding of their own.
SINGLE, SHARED, INPUTS = 48, 16, 2048
#: Weight of the classes' own frequencies in what is counted of an input.
PRIOR = 4.0
#: Documents that the weights start from, steps, windows a step.
SAMPLE, STEPS, BATCH = 300, 500, 96
#: All of the fold trains the weights then, in shards of about so many subwords, by about so many steps of ``BATCH`` windows to so many.
SHARD, FOLD_STEPS, FOLD_BATCH = 1 << 22, 256, 384
#: Windows whose gradient is taken at once, which fits a core's cache, and shards whose changes are summed at once.
PART, FAN = 64, 64
#: Parts that the weights' changes are summed in.
SLICES = 16
#: Windows that are scored at once; their logits fit a core's cache.
BLOCK = 128


#: What :func:`_read` gives: counts of words by hash, counts of subwords by id, and documents.
WORD, SUBWORD, DOCUMENT = 0, 1, 2
READ = "kind int, key long, n long, doc_id long, train boolean, ids binary, words binary, times binary"


#: Subword ids and numbers of a word in a document as they are stored; what doesn't fit takes several entries.
IDS, TIMES = "<u4", "<u2"


def _packed_ids(ids: np.ndarray, size: int) -> np.ndarray:
    return ids.astype("<u2" if size <= 1 << 16 else IDS)


def _read_ids(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if size <= 1 << 16 else IDS).astype(np.int64)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    which, u = pd.factorize(np.concatenate(hashes))
    return u, np.bincount(which, np.concatenate(counts), len(u)).astype(np.int64)


def _own_words(words: tn.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each text's distinct words, their numbers, where each text's begin; all distinct hashes, and which of them each is)."""
    owner = np.repeat(np.arange(len(words.first) - 1), words.count)
    which, every = pd.factorize(words.hash)
    pair, u = pd.factorize(owner * len(every) + which)  # texts come one after another, and so do their pairs
    n = np.bincount(pair, minlength=len(u))
    owner, which = (u // len(every), u % len(every)) if len(every) else (u, u)
    entries = -(-n // 0xFFFF)  # where the number of one is as large as it can be, more entries follow
    if len(n) and entries.max() > 1:
        nth = np.arange(entries.sum()) - np.repeat(np.cumsum(entries) - entries, entries)
        n = np.minimum(np.repeat(n, entries) - nth * 0xFFFF, 0xFFFF)
        owner, which = np.repeat(owner, entries), np.repeat(which, entries)
    return every[which], n, np.searchsorted(owner, np.arange(len(words.first))), every, which


_pretokens: dict[int, tuple[bpe.Encoder, bpe.Known]] = {}


def _known_pretokens(encoder: bpe.Encoder) -> bpe.Known:
    """What this worker knows of the encoder's pretokens."""
    if id(encoder) not in _pretokens:
        _pretokens.clear()
        _pretokens[id(encoder)] = encoder, bpe.Known(KNOWN)
    return _pretokens[id(encoder)][1]


def _read(spec):
    """Documents (``n`` is their tokens) and the training fold's partial counts, from key, doc_id, train and text."""

    def rows(kind: int, key, n, doc_id=None, train=None, ids=None, words=None, times=None) -> pa.RecordBatch:
        size = len(key)
        columns = [pa.array(np.full(size, kind, np.int32)), pa.array(key), pa.array(n)]
        for value, of in ((doc_id, pa.int64()), (train, pa.bool_()), (ids, pa.binary()), (words, pa.binary()), (times, pa.binary())):
            columns.append(pa.nulls(size, of) if value is None else value)
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._encoder(spec.value)
        known = _known_pretokens(encoder)
        size = len(encoder.vocab.bytes) + 1
        counts = np.zeros(size, np.int64)
        hashes, numbers, held = [], [], 0

        def documents(segment: bpe.Segment) -> Iterator[pa.RecordBatch]:
            for (own, fold, n, h, times, at), ids, edge in segment.encoded():
                inside = np.repeat(fold, np.diff(edge))
                counts[:] += np.bincount(ids[inside], minlength=size)
                counts[-1] += fold.sum()
                wide = _packed_ids(ids, size)
                packed = (bpe._packed(pa.binary(), edge * wide.itemsize, wide), bpe._packed(pa.binary(), at * 8, h), bpe._packed(pa.binary(), at * 2, times.astype(TIMES)))
                yield rows(DOCUMENT, own[0], n, own[1], own[2], *packed)

        segment = bpe.Segment(encoder, known)
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in tn.chunks(batch.column(3)):
                data = tn.LOWER[data]
                words = tn.Words(data, offsets, lower=False)
                h, times, at, every, which = _own_words(words)
                fold = train[lo:hi]
                inside = np.repeat(fold, np.diff(at))
                if inside.any():
                    n = np.bincount(which[inside], times[inside], len(every)).astype(np.int64)
                    u, n = every[n > 0], n[n > 0]
                    hashes.append(u)
                    numbers.append(n)
                    held += len(u)
                if held > 2 * GATHER:
                    u, n = _merged(hashes, numbers)
                    hashes, numbers, held = [u], [n], len(u)
                    if held > GATHER:
                        yield rows(WORD, u.view(np.int64), n)
                        hashes, numbers, held = [], [], 0
                segment.add(data, offsets, (bpe._columns(batch, lo, hi, []), fold, words.count + 1, h, times, at))
                if segment.bytes >= SEGMENT:
                    yield from documents(segment)
                    segment = bpe.Segment(encoder, known)
        if segment._chunks:
            yield from documents(segment)
        if hashes:
            u, n = _merged(hashes, numbers)
            yield rows(WORD, u.view(np.int64), n)
        some = np.flatnonzero(counts)
        yield rows(SUBWORD, some, counts[some])

    return run


class Shape:
    """How subword ids map to classes and inputs, and the log probability of each within its class."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        order = np.concatenate([[size - 1], order[order != size - 1]])  # the end is a class of its own
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        smooth = counts + 1.0
        rest = order[SINGLE:]
        mass = np.cumsum(smooth[rest])
        self.of = np.empty(size, np.int64)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, size))
        self.of[rest] = SINGLE + np.minimum((mass - smooth[rest]) / mass[-1] * SHARED, SHARED - 1).astype(np.int64)
        total = np.bincount(self.of, smooth, minlength=SINGLE + SHARED)
        self.within = np.log(smooth / total[self.of]).astype(np.float32)
        self.prior = np.log(np.maximum(total, 1) / total.sum()).astype(np.float32)
        # inputs: frequent subwords, one for each class of the others, and the begin
        self.input = np.where(rank < INPUTS, rank, INPUTS + self.of)
        self.inputs = INPUTS + SINGLE + SHARED + 1

    def pairs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each input is followed by each class in the texts, the begin and the end included; by input, then class."""
        c = SINGLE + SHARED
        follows = np.append(self.of[ids], 0)
        some = at[1:] > at[:-1]
        first = np.where(some, follows[at[:-1]], self.of[-1])
        follows = follows[1:]
        follows[at[1:][some] - 1] = self.of[-1]
        return np.bincount(self.input[ids] * c + follows, minlength=self.inputs * c) + np.bincount((self.inputs - 1) * c + first, minlength=self.inputs * c)

    def logits(self, pairs: np.ndarray) -> np.ndarray:
        """By input and class, how much likelier than by its own frequency the class is behind the input."""
        n = pairs.reshape(self.inputs, -1)
        prior = np.exp(self.prior.astype(np.float64))
        return np.log((n / prior + PRIOR) / (n.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)


def _weighed(logits, z: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
    """(exponentials of ``z`` in its place, their sums by row, what was taken off each row): none overflows, nor do all of a row vanish.

    Callers ignore the overflow of the first go; ``logits`` makes ``z`` once more where that takes another go.
    """
    total = np.exp(z, out=z) @ ones
    if not len(z) or (total.min() > 1e-25 and total.max() < 1e25):
        return z, total, 0
    z = logits()
    top = z.max(axis=1, keepdims=True)
    z -= top
    return z, np.exp(z, out=z) @ ones, top[:, 0]


_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(OVERLAP, WINDOW)[:, None]).astype(np.float32)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the one of ``to`` that ``at`` says.

    numpy adds many times faster by index where arrays are flat and of its own types, not of the equal ones that
    pickled arrays (and what is computed from them) bring along: hence the views.
    """
    # two by two, as complex numbers; a table's rows are copied faster than short rows are reckoned
    width, own = to.shape[1] // 2, np.result_type(to.dtype, np.complex64).type
    index = np.arange(len(to) * width, dtype=np.intp).reshape(-1, width).take(at, axis=0).reshape(-1)
    np.add.at(to.reshape(-1).view(own), index, np.ascontiguousarray(rows).reshape(-1).view(own))


class Attention:
    def __init__(self, shape: Shape, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 and s[0] <= 64 else 1)).astype(np.float32)
        c = SINGLE + SHARED
        self.shape = shape
        self.p = {"E": draw(shape.inputs, WIDTH), "P": draw(WINDOW, WIDTH), "Q": draw(WIDTH, WIDTH), "K": draw(WIDTH, WIDTH), "V": draw(WIDTH, WIDTH), "U": draw(WIDTH, c), "B": np.zeros((shape.inputs, c), np.float32)}
        self.p["b"] = shape.prior.copy()

    def blocks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number within it) of each window."""
        blocks = -(-(np.diff(at) + 1) // STRIDE)
        text = np.repeat(np.arange(len(blocks)), blocks)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)

    def full_first(self, at: np.ndarray, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The order that puts windows without missing inputs first, so that few batches need masks for them."""
        last = k * STRIDE - OVERLAP + WINDOW
        return np.argsort((k == 0) | (last > (np.diff(at) + 1)[text]), kind="stable")

    def windows(self, padded: np.ndarray, at: np.ndarray, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs with -1 where there is none, target ids, whether a place is scored) by window; one id more follows the texts'."""
        n, first = (np.diff(at) + 1)[text], k * STRIDE - OVERLAP
        gaps = np.flatnonzero((first <= 0) | (first + WINDOW > n))
        full = int(gaps[0]) if len(gaps) else len(k)  # so many at the front lack no input
        end, parts = len(self.shape.of) - 1, []
        if full:
            every = np.ndarray((len(padded) - WINDOW, WINDOW + 1), padded.dtype, padded, strides=padded.strides * 2)
            own = every[(at[text] + first)[:full] - 1]
            inputs = self.shape.input.take(own[:, :WINDOW], mode="clip")
            own[first[:full] + WINDOW == n[:full], -1] = end
            parts.append((inputs, own[:, OVERLAP + 1 :], np.ones((full, STRIDE), bool)))
        if full < len(k) or not len(k):
            n, place = n[full:, None], first[full:, None] + np.arange(WINDOW)
            inside = (place >= 0) & (place < n)
            own = at[text[full:]][:, None] + place
            prev = np.clip(own - 1, 0, len(padded) - 1)
            inputs = np.where(inside, np.where(place == 0, self.shape.inputs - 1, self.shape.input[padded[prev]]), -1)
            target = np.where(place[:, OVERLAP:] == n - 1, end, padded[np.clip(own[:, OVERLAP:], 0, len(padded) - 1)])
            parts.append((inputs, target, inside[:, OVERLAP:]))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def gradient(self, inputs: np.ndarray, classes: np.ndarray, scored: np.ndarray, weight: float, g: dict[str, np.ndarray], both: np.ndarray | None = None) -> None:
        """Adds to ``g`` the gradient of ``weight`` times the loss, summed over all scored places; ``both`` is B + b.

        ``Q`` and ``K`` only occur as a product, and sums of values are ``V`` times sums of inputs: so neither keys nor
        values are made, and what all inputs of a window took is done for its own places.
        """
        p, ones = self.p, np.ones(SINGLE + SHARED, np.float32)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        scale = np.float32(1 / np.sqrt(WIDTH))
        meet = p["Q"] @ p["K"].T * scale
        x = p["E"].take(inputs, axis=0, mode="wrap")
        x += p["P"]
        x_own = np.ascontiguousarray(x[:, OVERLAP:])
        x_t, places = x.transpose(0, 2, 1), flat(x_own)
        q = (places @ meet).reshape(x_own.shape)
        missing = inputs < 0
        some = missing.any()

        def seen(bounded: bool) -> tuple[np.ndarray, np.ndarray]:
            a = q @ x_t
            if bounded:
                np.clip(a, -30, 30, out=a)
            np.exp(a, out=a)
            a *= _CAUSAL
            if some:
                a *= ~missing[:, None, :]
            return a, flat(a) @ ones[:WINDOW]

        a, total = seen(some)
        if not some and len(a) and not (total.min() > 1e-5 and total.max() < 1e12):  # bounds may count
            a, total = seen(True)
        a *= (1 / np.maximum(total, 1e-30)).reshape(-1, STRIDE, 1)
        mean = flat(a @ x)
        h = mean @ p["V"]
        h += places
        own = inputs[:, OVERLAP:].ravel()
        both = p["B"] + p["b"] if both is None else both

        def logits() -> np.ndarray:
            z = h @ p["U"]
            z += both.take(own, axis=0, mode="wrap")
            return z

        dz, total, _ = _weighed(logits, logits(), ones)  # but for a factor by place
        dz.reshape(-1)[np.arange(0, dz.size, dz.shape[1]) + classes.ravel()] -= total
        factor = np.float32(weight) / total
        if some:
            factor = np.where(scored.ravel(), factor, np.float32(0))
        dz *= factor[:, None]
        g["b"] += np.ones(len(dz), np.float32) @ dz
        if "B" in g:
            _add_rows(g["B"], own % len(g["B"]), dz)
        g["U"] += (dz.T @ h).T
        dh = dz @ p["U"].T
        g["V"] += mean.T @ dh
        d_mean = dh @ p["V"].T
        mean *= d_mean
        taken = (mean @ ones[:WIDTH]).reshape(-1, STRIDE, 1)
        d_mean = d_mean.reshape(x_own.shape)
        ds = d_mean @ x_t
        ds -= taken
        ds *= a
        dx = ds.transpose(0, 2, 1) @ q
        dx += a.transpose(0, 2, 1) @ d_mean
        dq = flat(ds @ x)
        d_meet = places.T @ dq
        d_meet *= scale
        g["Q"] += d_meet @ p["K"]
        g["K"] += d_meet.T @ p["Q"]
        dh += dq @ meet.T
        dx[:, OVERLAP:] += dh.reshape(x_own.shape)
        if some:
            there = ~missing
            g["P"] += np.where(there[:, :, None], dx, 0).sum(axis=0)
            _add_rows(g["E"], inputs[there], dx[there])
        else:
            g["P"] += dx.sum(axis=0)
            _add_rows(g["E"], inputs.ravel(), flat(dx))

    def train(self, ids: np.ndarray, at: np.ndarray, steps: int | None = STEPS, rate: float = 0.02, seed: int = 1, batch: int = BATCH) -> int:
        """Adam over windows drawn from the texts, or with no ``steps`` once over all; gives the number of windows."""
        text, k = self.blocks(at)
        if not len(text):
            return 0
        padded = np.append(ids, 0)
        rng = np.random.default_rng(seed)
        w = np.concatenate([x.ravel() for x in self.trained().values()])
        m, s2, flat_g, edge, g = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0, {}
        for n, x in self.trained().items():  # the weights and their gradients are parts of one array each
            self.p[n], g[n] = (y[edge : edge + x.size].reshape(x.shape) for y in (w, flat_g))
            edge += x.size
        both = np.empty_like(self.p["B"])
        np.empty(24 << 20, np.uint8)  # once glibc has given back so much, it keeps what each part allocates and frees
        order = rng.permutation(len(text)) if steps is None else None
        steps = -(-len(text) // batch) if steps is None else steps
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(text), batch) if order is None else order[(step - 1) * batch : step * batch]
            pick = pick[self.full_first(at, text[pick], k[pick])]
            inputs, target, scored = self.windows(padded, at, text[pick], k[pick])
            classes, weight, both = self.shape.of[target], 1 / max(1, scored.sum()), np.add(self.p["B"], self.p["b"], out=both)
            with np.errstate(over="ignore", invalid="ignore"):
                for lo in range(0, len(pick), PART):
                    self.gradient(inputs[lo : lo + PART], classes[lo : lo + PART], scored[lo : lo + PART], weight, g, both)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            by_m, by_s = np.float32(lr / (1 - 0.9**step)), np.float32(1 / np.sqrt(1 - 0.99**step))
            m *= np.float32(0.9)
            m += np.float32(0.1) * flat_g
            s2 *= np.float32(0.99)
            np.square(flat_g, out=flat_g)
            flat_g *= np.float32(0.01)
            s2 += flat_g
            np.sqrt(s2, out=flat_g)
            flat_g *= by_s
            flat_g += np.float32(1e-6)
            np.divide(m, flat_g, out=flat_g)
            flat_g *= by_m
            w -= flat_g
            flat_g.fill(0)
        return len(text)

    def trained(self) -> dict[str, np.ndarray]:
        """The weights that training moves: all but those that are counted."""
        return {n: w for n, w in self.p.items() if n != "B"}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.trained().values()]).astype(np.float64)

    def move(self, change: np.ndarray) -> None:
        at = 0
        for n, w in self.trained().items():
            self.p[n] = w + change[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def tables(self) -> dict[str, np.ndarray]:
        p = self.p
        out = {n: np.ascontiguousarray(p["E"] @ p[n], np.float32) for n in "QKV"}
        out |= {f"P{n}": p["P"] @ p[n] for n in "QKV"}
        out["Q"], out["PQ"] = out["Q"] / np.sqrt(WIDTH, dtype=np.float32), out["PQ"] / np.sqrt(WIDTH, dtype=np.float32)
        keys, values = np.hstack([out["K"], out["V"]]), np.hstack([out["PK"], out["PV"]])
        return {"Q": out["Q"], "PQ": out["PQ"], "KV": keys, "PKV": values, "Z": p["E"] @ p["U"] + p["B"] + p["b"]}

    def bound(self, tables: dict[str, np.ndarray]) -> float:
        """No attention score is larger than this in absolute value, whatever the input."""
        norm = lambda x: float(np.linalg.norm(x, axis=1).max())
        t = tables
        query = norm(t["Q"]) + norm(t["PQ"])
        return query * (norm(t["KV"][:, :WIDTH]) + norm(t["PKV"][:, :WIDTH]))

    def score(self, ids: np.ndarray, at: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of each text: its subwords, then the end."""
        out = np.zeros(len(at) - 1)
        all_text, k = self.blocks(at)
        order = self.full_first(at, all_text, k)
        all_text, k, padded = all_text[order], k[order], np.append(ids, 0)
        t, attended = tables, self.bound(tables)
        ones = np.ones(SINGLE + SHARED, np.float32)
        np.empty(24 << 20, np.uint8)  # as in training
        for lo in range(0, len(k), BLOCK):
            text = all_text[lo : lo + BLOCK]
            inputs, target, scored = self.windows(padded, at, text, k[lo : lo + BLOCK])
            own = inputs[:, OVERLAP:]
            q = t["Q"].take(own, axis=0, mode="wrap")
            q += t["PQ"][OVERLAP:]
            kv = t["KV"].take(inputs, axis=0, mode="wrap")
            kv += t["PKV"]
            e = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
            if attended > 30:
                np.clip(e, -30, 30, out=e)
            np.exp(e, out=e)
            e *= _CAUSAL
            missing = inputs < 0
            if missing.any():
                e *= ~missing[:, None, :]
            h = e @ kv[:, :, WIDTH:]
            h *= (1 / np.maximum(e.reshape(-1, WINDOW) @ ones[:WINDOW], 1e-30)).reshape(-1, STRIDE, 1)
            h += self.p["P"][OVERLAP:]

            def logits(h=h, own=own) -> np.ndarray:
                z = h.reshape(-1, WIDTH) @ self.p["U"]
                z += t["Z"].take(own.ravel(), axis=0, mode="wrap")
                return z

            z = logits()
            target = target.ravel()
            got = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + self.shape.of[target]].astype(np.float64)
            with np.errstate(over="ignore"):
                _, total, top = _weighed(logits, z, ones)
            got += self.shape.within[target] - np.log(total) - top
            got = np.where(scored.ravel(), got, 0.0).reshape(len(own), STRIDE).sum(axis=1)
            np.add.at(out, text, got)
        return out / np.log(10)


def _places(hashes: np.ndarray, begin: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of ``h`` stands among the sorted ``hashes``, or -1; those of one start of ``TOP`` bits begin at ``begin``."""
    top = (h >> np.uint64(64 - TOP)).astype(np.int64)
    out = np.full(len(h), -1)
    at, end = begin[top], begin[top + 1]
    row = np.flatnonzero(at < end)
    at, end = at[row], end[row]
    while len(row):
        same = hashes[at] == h[row]
        out[row[same]] = at[same]
        at += 1
        more = ~same & (at < end)
        row, at, end = row[more], at[more], end[more]
    return out


def _known(hot):
    """From key, doc_id, n, words and times: what broadcast words give, and the other words as ``rare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = hot.value
        gain = np.log10(counts + 1.0)
        begin = np.searchsorted(hashes >> np.uint64(64 - TOP), np.arange((1 << TOP) + 1, dtype=np.uint64))
        for batch in batches:
            for lo, hi, data, offsets in tn.chunks(batch.column(3)):
                n = hi - lo
                h = np.frombuffer(data.tobytes(), "<u8")
                times_data, times_at = tn.buffers(batch.column(4).slice(lo, n))
                times = np.frombuffer(times_data[times_at[0] : times_at[-1]].tobytes(), TIMES).astype(np.int64)
                text = np.repeat(np.arange(n), np.diff(offsets) // 8)
                k = _places(hashes, begin, h)
                found = k >= 0
                known = np.bincount(text[found], times[found], minlength=n).astype(np.int64)
                total = np.bincount(text[found], gain[k[found]] * times[found], minlength=n).astype(np.float64)
                edge = np.searchsorted(text[~found], np.arange(n + 1)).astype(np.int32)
                pair = pa.StructArray.from_arrays([pa.array(h[~found].view(np.int64)), pa.array(times[~found].astype(np.int32))], names=["h", "k"])
                columns = [c.slice(lo, n) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(known), pa.array(total), pa.ListArray.from_arrays(pa.array(edge), pair)], names=["key", "doc_id", "n_tokens", "known", "total", "rare"])

    return run


def _score(model):
    """From key and ids: the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention: Attention = model.value
        tables, size = attention.tables(), len(attention.shape.of)
        for batch in batches:
            for lo, hi, data, offsets in tn.chunks(batch.column(1), 1 << 19):
                width = 2 if size <= 1 << 16 else 4
                score = attention.score(_read_ids(data.tobytes(), size), offsets // width, tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], names=["key", "score"])

    return run


def _joined(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets) of packed ids of a vocabulary of ``size``."""
    own = [_read_ids(t, size) for t in texts]
    return np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)


def _change(start, rate: float):
    """A shard's change of the weights by one pass over its windows, times their number, in slices."""

    def run(group: pa.Table) -> pa.Table:
        model: Attention = copy.deepcopy(start.value)
        before = model.flat()
        # in the order of the texts, so that the result doesn't depend on how rows came here
        ids, at = _joined(sorted(group.column("ids").to_pylist()), len(model.shape.of))
        batch = min(FOLD_BATCH, max(BATCH, len(ids) // (STRIDE * FOLD_STEPS)))
        n = model.train(ids, at, steps=None, rate=rate, batch=batch)
        parts = np.array_split(((model.flat() - before) * n).astype("<f4"), SLICES)
        shard = group.column("shard")[0].as_py()
        return pa.table({"shard": [shard] * SLICES, "slice": list(range(SLICES)), "n": [n] * SLICES, "change": [x.tobytes() for x in parts]})

    return run


def _summed(group: pa.Table) -> pa.Table:
    """The changes of one slice in sum, those of ``FAN`` neighbouring shards as one."""
    group = group.sort_by("shard")
    total = 0
    for x in group.column("change"):
        total = total + np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
    shard = group.column("shard")[0].as_py() // FAN
    return pa.table({"shard": [shard], "slice": [group.column("slice")[0].as_py()], "n": [sum(group.column("n").to_pylist())], "change": [total.astype("<f4").tobytes()]})


def _pairs(shape):
    """From ids: a task's counts of the pairs of an input and the class behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Shape = shape.value
        size, counts = len(own.of), 0
        for batch in batches:
            for _, _, data, offsets in tn.chunks(batch.column(0)):
                counts = counts + own.pairs(_read_ids(data.tobytes(), size), offsets // (2 if size <= 1 << 16 else 4))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.asarray(counts).reshape(-1)[some], pa.int64())], names=["key", "n"])

    return run


def _count_on_fold(model: Attention, fold: DataFrame) -> None:
    """The logits that are counted, over all documents of ``fold`` (ids)."""
    pairs = fold.select("ids").mapInArrow(_pairs(fold.sparkSession.sparkContext.broadcast(model.shape)), "key long, n long")
    rows = pairs.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # as many as B has numbers at most
    counts = np.zeros(model.p["B"].size)
    counts[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    model.p["B"] = model.shape.logits(counts)


def _train_on_fold(model: Attention, fold: DataFrame, subwords: int, rate: float = 0.02) -> None:
    """Training on all documents of ``fold`` (doc_id, ids), by shards in parallel; the changes are averaged.

    Shards hold about as many of the fold's ``subwords`` each, at any size.
    """
    shards = max(1, round(subwords / SHARD))
    dealt = fold.select(F.pmod(F.xxhash64("doc_id", "ids", F.lit(13)), F.lit(shards)).alias("shard"), "ids")
    start = fold.sparkSession.sparkContext.broadcast(model)
    schema = "shard long, slice long, n long, change binary"
    changes = dealt.groupBy("shard").applyInArrow(_change(start, rate), schema)
    while shards > 1:  # no task sums more than FAN changes
        changes = changes.groupBy("slice", F.floor(F.col("shard") / FAN)).applyInArrow(lambda _, group: _summed(group), schema)
        shards = -(-shards // FAN)
    rows = changes.collect()
    total = max((r.n for r in rows), default=0)
    if total:
        model.move(np.concatenate([np.frombuffer(r.change, "<f4") for r in sorted(rows, key=lambda r: r.slice)]) / total)


def _least_hot(words: DataFrame, hot: int) -> int:
    """The least count from which on there are at most ``hot`` words.

    Words are counted by classes of like count (64 to a doubling), so that the driver gets no more rows than there
    are classes, however many tasks have words.
    """
    kind = F.floor(64 * F.log2(F.col("n").cast("double")))
    classes = words.groupBy(kind.alias("c")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(classes, key=lambda r: -r.c):
        held += r.m
        if held > hot:
            break
        least = r.least
    return least


def score(docs: DataFrame, training: Column, spec, sample: int = SAMPLE, steps: int = STEPS, hot: int = HOT) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows where ``training`` (of doc_id) holds. Words are maximal runs of non-space bytes after
    lower-casing A-Z; an end is counted as a token of every text. ``base_score`` is the sum over tokens of
    log10((c + 1) / (N + V + 1)) with the fold's counts; ``score`` is the model's log10 probability of the
    lower-cased text's subwords and the end. Null counts as empty: just the end. Equal rows each give a row, extra
    columns are ignored, and rows without doc_id are scored but never learned from. Without training rows all
    counts are 0 and the weights stay as drawn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(training & F.col("doc_id").isNotNull(), F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    read = scratch.table(docs.mapInArrow(_read(spec), READ), "read", by="kind", codec="zstd")
    counts = read.where(f"kind < {DOCUMENT}").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "counts")
    words = counts.where(f"kind = {WORD}").select("key", "n")
    size = len(bpe.Vocabulary(json.loads(spec.value)).bytes) + 1
    by_id = np.zeros(size)
    for r in counts.where(f"kind = {SUBWORD}").collect():  # as many as the vocabulary has at most
        by_id[r.key] = r.n
    ends = int(by_id[-1])
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (total.n or 0) + ends, total.v + (ends > 0)

    model = Attention(Shape(by_id))
    fold = read.where(f"kind = {DOCUMENT} and train")
    first = [r.key for r in fold.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids"), "key").limit(sample).select("key").collect()]
    some = {r.key: bytes(r.ids) for r in fold.where(F.col("key").isin(first)).select("key", "ids").collect()}
    _count_on_fold(model, fold)
    model.train(*_joined([some[k] for k in first], size), steps)
    _train_on_fold(model, fold.select("doc_id", "ids"), int(by_id.sum()))

    top = words.where(F.col("n") >= _least_hot(words, hot)).collect()  # at most ``hot`` rows
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    tops = (keys[order], np.array([r.n for r in top], np.int64)[order])
    send = spark.sparkContext.broadcast
    documents = read.where(f"kind = {DOCUMENT}")
    schema = "key long, doc_id long, n_tokens long, known long, total double, rare array<struct<h:long,k:int>>"
    scored = scratch.table(documents.select("key", "doc_id", "n", "words", "times").mapInArrow(_known(send(tops)), schema), "known")
    by_model = scratch.table(documents.select("key", "ids").mapInArrow(_score(send(model)), "key long, score double"), "scores")
    scratch.drop("read")
    rare = scored.select("key", F.explode("rare").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.k").alias("k"))
    rare = rare.join(words.toDF("h", "n").hint("merge"), "h").groupBy("key").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("total"))
    out = scored.drop("rare").join(by_model.hint("merge"), "key").join(rare.toDF("key", "more", "gain").hint("merge"), "key", "left")
    gain = F.col("total") + F.coalesce("gain", F.lit(0.0)) + float(np.log10(ends + 1.0))
    base = gain - F.col("n_tokens") * float(np.log10(n + v + 1.0))
    known = (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known")
    return out.select("doc_id", "n_tokens", known, F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
