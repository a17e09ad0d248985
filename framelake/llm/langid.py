"""Language identification by cross-parsing entropy.

A suffix automaton of each language's reference text gives, at any place of a text, the longest match with that
language; a greedy parse cuts the text into such phrases. A language in which the text falls into few phrases is
near. Phrases are normalised as ``phrases * log2(reference length) / length``, an estimate of the cross entropy in
bits a character, and the least wins.

Automata are stored sparsely: the transitions of all states share one array (row displacement), so a script of many
letters costs no more than its references have transitions. Texts are parsed whole. Blocks of ``BLOCK`` letters are
parsed side by side as lanes of one vector; a block is parsed again from the state in which the block before it
really ends, until the new states meet the old ones, so the result is that of one parse from end to end.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textnum as tn
from .store import Scratch

#: Reference letters by language: labelled text that the classifier is fitted on, in spans of at most SPAN characters
#: from at most DOCUMENTS documents, those with the least hash of doc_id.
REFERENCE, SPAN, DOCUMENTS = 60_000, 400, 240
#: Letters that are parsed side by side as one lane.
BLOCK = 512
#: Languages whose automata are broadcast at once (about 1.5 MB each); more are taken in several passes.
LANGUAGES = 32
#: Languages that are parsed side by side.
TOGETHER = 8

UNKNOWN = "und"


def _letters() -> np.ndarray:
    kinds = np.zeros(0x110000, bool)
    kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    return kinds


_state: dict[str, object] = {}


def letters() -> np.ndarray:
    if "letters" not in _state:
        _state["letters"] = _letters()
    return _state["letters"]


def normal(text: str) -> str:
    """Lower case; runs of other characters than letters become one blank, none at the ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _collapsed(np.where(letters()[code], code, 32).astype(np.uint32)).tobytes().decode("utf-32-le").strip()


def _collapsed(code: np.ndarray) -> np.ndarray:
    keep = code != 32
    keep[1:] |= code[:-1] != 32
    return code[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton of all substrings; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def displaced(go: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to): state s goes by symbol c to ``to[base[s] + c]`` if ``owner[base[s] + c]`` is s."""
    base = np.zeros(len(go), np.int64)
    wide = sorted((s for s in range(len(go)) if len(go[s]) > 1), key=lambda s: (-len(go[s]), s))
    used, top, low = bytearray(1 << 16), 0, 0
    cells: list[tuple[int, int, int]] = []
    for s in wide:
        own = sorted(go[s])
        first = own[0]
        shift = [c - first for c in own[1:]]
        reach = shift[-1]
        place, tries = used.find(0, low), 0
        while place < top:
            if len(used) <= place + reach:
                used.extend(bytes(len(used) + reach))
            for c in shift:
                if used[place + c]:
                    break
            else:
                break
            tries += 1
            if tries < 16:
                place = used.find(0, place + 1)
            elif tries < 48:  # somewhere among the cells that are less full
                place = used.find(0, low + (s * 40503 + tries * 7919) % max(1, top - low))
            else:
                place = top
        if len(used) <= place + reach + 1:
            used.extend(bytes(len(used) + reach))
        for c in own:
            used[place + c - first] = 1
            cells.append((place + c - first, s, go[s][c]))
        base[s] = place - first
        top = max(top, place + reach + 1)
        if tries >= 16:  # cells before this place are left to states of one transition
            low = used.find(0, low + 8)
    del used[top:]
    free = np.flatnonzero(np.frombuffer(bytes(used), np.uint8) == 0)
    single = [s for s in range(len(go)) if len(go[s]) == 1]
    if len(single) > len(free):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(single) - len(free))])
    size = max(len(used), int(free[: len(single)].max()) + 1 if single else 0, 1)
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for place, s, t in cells:
        owner[place], to[place] = s, t
    for s, place in zip(single, free.tolist(), strict=False):
        ((c, t),) = go[s].items()
        base[s], owner[place], to[place] = place - c, s, t
    return base, owner, to


class Automata:
    """The automata of some languages side by side."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        shared = sorted({c for t in texts.values() for c in t} | {" "})
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no reference
        self.symbol[[ord(c) for c in shared]] = np.arange(1, len(shared) + 1)
        alphabet = len(shared) + 1
        bases, owners, tos, self.root, states, cells = [], [], [], [], 0, alphabet
        self.first = np.full((len(self.languages), alphabet), -1, np.int32)  # from the start, by symbol
        for k, name in enumerate(self.languages):
            go = suffix_automaton(self.symbol[[ord(c) for c in texts[name]]].tolist())
            base, owner, to = displaced(go)
            for c, t in go[0].items():
                self.first[k, c] = t + states
            pad = np.full(alphabet, -1, np.int32)  # a base may point before or behind its own cells
            bases.append(base + cells)
            owners += [np.where(owner >= 0, owner + states, -1), pad]
            tos += [to + states, pad]
            self.root.append(states)
            states += len(go)
            cells += len(owner) + alphabet
        head = [np.full(alphabet, -1, np.int32)]
        self.base = np.concatenate(bases).astype(np.int32) if bases else np.zeros(0, np.int32)
        self.cell = np.concatenate(head + owners).astype(np.int64) << 32 | np.concatenate(head + tos).astype(np.int64) & 0xFFFFFFFF
        self.root = np.array(self.root, np.int32)
        self.bits = np.array([math.log2(max(2, len(texts[name]))) for name in self.languages])

    def step(self, k: np.ndarray, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, phrases that end) of languages ``k`` on reading ``sym``."""
        cell = self.cell[self.base[state] + sym]
        new = cell.astype(np.int32)
        miss = np.flatnonzero(cell >> 32 != state)
        ended = np.zeros(len(state), np.uint8)
        if len(miss):
            # a match ends and a new one starts here; a letter that starts none is a phrase of its own
            root = self.root[k[miss]]
            first = self.first[k[miss], sym[miss]]
            none = first < 0
            ended[miss] = (state[miss] != root).astype(np.uint8) + none
            new[miss] = np.where(none, root, first)
        return new, ended

    def phrases(self, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts, languages) phrases of texts of ``n`` symbols that stand one after another in ``sym``."""
        out = np.zeros((len(n), len(self.languages)), np.int64)
        blocks = -(-n // BLOCK)
        lanes = int(blocks.sum())
        if not lanes:
            return out
        text = np.repeat(np.arange(len(n)), blocks)
        rank = np.arange(lanes) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (np.cumsum(n) - n)[text] + rank * BLOCK
        size = np.minimum(BLOCK, n[text] - rank * BLOCK)
        last = np.append(rank[1:] == 0, True)
        for lo in range(0, len(self.languages), TOGETHER):
            group = np.arange(lo, min(lo + TOGETHER, len(self.languages)))
            tile = lambda x: np.tile(x, len(group))
            language = np.repeat(group, lanes)
            root = self.root[language]
            run = _Lanes(self, language, sym, tile(at), tile(size))
            run.parse(root.copy(), np.arange(len(root)), False)
            enter, follows = root.copy(), tile(rank) > 0
            while True:
                real = np.where(follows, np.roll(run.leave, 1), root)
                again = np.flatnonzero(real != enter)
                if not len(again):
                    break
                enter = real
                run.parse(enter, again, True)
            total = np.add.reduce(run.ends, axis=0, dtype=np.int64) + (tile(last) & (run.leave != root))  # with the phrase in which a text ends
            for k, row in zip(group, total.reshape(len(group), -1), strict=True):
                out[:, k] = np.bincount(text, row, minlength=len(n)).astype(np.int64)
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits a letter, and each text's letters."""
        parts = [t.lower() for t in texts]
        size = np.array([len(t) for t in parts], np.int64)
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(parts)), size)
        is_letter = letters()[code]
        keep = is_letter.copy()  # a blank stands before each run of letters but a text's first
        first = np.ones(len(code), bool)
        first[1:] = owner[1:] != owner[:-1]
        gap = ~is_letter
        keep[:-1] |= gap[:-1] & is_letter[1:] & ~first[1:]
        seen = np.cumsum(is_letter)
        begin = np.concatenate([[0], np.cumsum(size)])
        before = np.concatenate([[0], seen])[begin[:-1]]
        blank = np.flatnonzero(keep & gap)
        keep[blank[seen[blank] == before[owner[blank]]]] = False
        sym = np.where(is_letter, self.symbol[code], self.symbol[32])[keep]
        n = np.bincount(owner[keep], minlength=len(parts))
        known = np.bincount(owner[is_letter], minlength=len(parts))
        return self.phrases(sym, n) * self.bits / np.maximum(n, 1)[:, None], known


class _Lanes:
    """Blocks of ``size`` letters from ``at`` on in ``sym``, each with its language, with what their parses did."""

    def __init__(self, automata: Automata, language, sym, at, size):
        self.automata, self.language, self.sym, self.at, self.size = automata, language, sym, at, size
        self.states = np.empty((BLOCK, len(at)), np.int32)  # before each step
        self.ends = np.zeros((BLOCK, len(at)), np.uint8)
        self.leave = np.empty(len(at), np.int32)

    def parse(self, enter: np.ndarray, lanes: np.ndarray, known: bool) -> None:
        """Parses ``lanes`` from their states ``enter``; where an earlier parse is ``known``, until its states are met."""
        lanes = lanes[np.argsort(-self.size[lanes], kind="stable")]
        state, language, size, at = enter[lanes], self.language[lanes], self.size[lanes], self.at[lanes]
        for t in range(BLOCK):
            keep = None
            if size[-1] <= t:
                keep = np.arange(int(np.searchsorted(-size, -t, "left")))
                self.leave[lanes[len(keep) :]] = state[len(keep) :]
            if known:
                live = slice(None) if keep is None else keep
                go_on = np.flatnonzero(state[live] != self.states[t, lanes[live]])
                keep = go_on if len(go_on) < len(lanes) else keep
            if keep is not None:
                lanes, state, language, size, at = lanes[keep], state[keep], language[keep], size[keep], at[keep]
                if not len(lanes):
                    return
            self.states[t, lanes] = state
            state, ended = self.automata.step(language, state, self.sym[at + t])
            self.ends[t, lanes] = ended
        self.leave[lanes] = state


def references(docs: DataFrame, reference: int = REFERENCE, documents: int = DOCUMENTS, span: int = SPAN) -> dict[str, str]:
    """Reference text by language of ``docs`` (doc_id, text, lang): at most ``reference`` letters of each.

    Of each language the ``documents`` with the least hash of doc_id give a span of at most ``span`` characters from
    a place drawn by that hash; every language that any text has is learned. Null languages and texts teach nothing.
    """
    docs = docs.where("lang is not null and text is not null and doc_id is not null")
    h = F.xxhash64("doc_id")
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - span + 1).cast("long"))
    docs = docs.select("lang", h.alias("h"), "doc_id", F.substring("text", (start + 1).cast("int"), F.lit(span)).alias("t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))  # cut to the first by task before rows move
    out: dict[str, list[str]] = {}
    for r in sorted(docs.withColumn("nth", nth).where(F.col("nth") <= documents).collect(), key=lambda r: (r.lang, r.nth)):
        if t := normal(r.t):
            out.setdefault(r.lang, []).append(t)
    return {lang: " ".join(t)[:reference] for lang, t in out.items()}


def _group(automata, text_at: int, names: list[str]):
    """Adds to lang, cost and the sum of inverse costs what these languages say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automata = automata.value
        for batch in batches:
            column = batch.column(text_at)
            for lo, hi, _, _ in tn.chunks(column):
                part = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                costs, known = own.costs(part)
                best = costs.argmin(axis=1)
                cost = costs[np.arange(len(part)), best]
                inverse = (1 / np.maximum(costs, 1e-9)).sum(axis=1)
                old = {c: batch.column(names.index(c)).slice(lo, hi - lo) for c in ("__lang", "__cost", "__sum")}
                had = old["__cost"].to_numpy(zero_copy_only=False)
                name = old["__lang"].to_pylist()
                better = (known > 0) & ((cost < had) | (cost == had) & np.array([n is not None and own.languages[b] < n for n, b in zip(name, best, strict=True)], bool))
                name = [own.languages[b] if y else n for n, b, y in zip(name, best, better, strict=True)]
                new = {"__lang": pa.array(name, pa.string()), "__cost": pa.array(np.where(better, cost, had)), "__sum": pa.array(old["__sum"].to_numpy(zero_copy_only=False) + inverse)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i).slice(lo, hi - lo)) for i, c in enumerate(names)], names=names)

    return run


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text", languages: int = LANGUAGES) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    ``texts`` are the references (a bounded text for each language). ``score`` is the winner's share of the inverse
    costs. A text that is null or has no letter, and any text where no language was learned, is ``und`` with score
    0. Ties go to the name that sorts first. Columns called lang_pred and score are replaced, all else stays. More
    than ``languages`` languages are compared in several passes over the texts.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    own = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    work = docs.toDF(*own).select(*own, F.lit(None).cast("string").alias("__lang"), F.lit(float("inf")).alias("__cost"), F.lit(0.0).alias("__sum"))
    at = docs.columns.index(text)
    names = sorted(texts)
    scratch = Scratch(spark) if len(names) > languages else None
    for lo in range(0, len(names), languages):
        group = spark.sparkContext.broadcast(Automata({n: texts[n] for n in names[lo : lo + languages]}))
        work = work.mapInArrow(_group(group, at, work.columns), work.schema)
        if scratch:
            work = scratch.table(work, f"languages-{lo}")
    score = F.when(F.col("__lang").isNull(), 0.0).otherwise(1 / F.greatest("__cost", F.lit(1e-9)) / F.col("__sum"))
    out = work.select(*own, F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"), F.least(score, F.lit(1.0)).alias("score"))
    return out.toDF(*docs.columns, "lang_pred", "score")
