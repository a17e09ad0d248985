"""Approximate nearest neighbours by additive quantisation and exact reranking.

A vector is coded as a sum of ``LEVELS`` full-dimensional codewords, found by a beam search over codebooks that
were trained on the residuals of the level before. Its norm is stored and scales the sum. Queries are scored
against codes through lookup tables of inner products with all codewords. The best of a block are reranked exactly
with the vectors themselves, and so is every other vector whose lookup score and the most that its quantisation
error can add reach the worst of the nearest found so far: nothing among a query's nearest is left out.

The index is written once in blocks of bounded size, codes beside vectors. Queries go to it in broadcasts of bounded
size; a task takes its blocks one after another and keeps each query's nearest, so that neither codes nor vectors are
shuffled for a search, and what later blocks are reranked for falls as the nearest come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

LEVELS, CODES, BEAM = 16, 256, 2
#: Vectors that the codebooks are trained on, drawn by a hash of the id.
SAMPLE = 6144
#: Rows of an index block, and candidates of a query that are reranked first.
INDEX_BLOCK, RERANK = 16384, 512
#: Bytes of query vectors that are broadcast at once; more are searched in several passes over the index.
QUERY_BYTES = 32 << 20
#: Queries that are scored together.
TOGETHER = 128


def train(x: np.ndarray, levels: int = LEVELS, codes: int = CODES, rounds: int = 5) -> np.ndarray:
    """(levels, codes, dimension) codebooks by k-means on residuals."""
    rng = np.random.default_rng(0)
    rest = x.astype(np.float32).copy()
    books = np.zeros((levels, codes, x.shape[1]), np.float32)
    for m in range(levels):
        book = rest[rng.choice(len(rest), codes, replace=len(rest) < codes)].copy()
        for _ in range(rounds):
            near = (rest @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=codes)
            some = n > 0
            first = (np.cumsum(n) - n)[some]
            book[some] = np.add.reduceat(rest[np.argsort(near, kind="stable")], first, axis=0) / n[some, None]
            if (~some).any():
                book[~some] = rest[rng.choice(len(rest), int((~some).sum()))]
        rest -= book[(rest @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)]
        books[m] = book
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(rows, levels) codes: the beam keeps the partial sums nearest to each vector."""
    x = x.astype(np.float32)
    out = np.empty((len(x), len(books)), np.uint8)
    for lo in range(0, len(x), 1024):
        rest = x[lo : lo + 1024, None, :]
        path = np.zeros((len(rest), 1, 0), np.uint8)
        for book in books:
            n, b, d = rest.shape
            cost = (rest**2).sum(axis=2)[..., None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, b, -1) + (book**2).sum(axis=1)
            k = min(beam, cost.shape[1] * cost.shape[2])
            best = np.argpartition(cost.reshape(n, -1), k - 1, axis=1)[:, :k]
            parent, code = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[code]
            path = np.concatenate([path[rows, parent], code[..., None].astype(np.uint8)], axis=2)
        out[lo : lo + 1024] = path[np.arange(len(path)), (rest**2).sum(axis=2).argmin(axis=1)]
    return out


def _usable(column: str) -> Column:
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda v: v != 0)


def _pack_index(books):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = np.asarray(group.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)[order]
        own = books.value
        # of equal vectors in a block no more than the first of each id order can be among a query's nearest
        same = x.view(f"V{x.shape[1] * 8}").ravel()
        _, which = np.unique(same, return_inverse=True)
        by = np.argsort(which, kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(which[by])) + 1])
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        codes = encode(x, own)
        made = own[np.arange(len(own)), codes].sum(axis=1)
        scale = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(made, axis=1), 1e-30)
        # how far the lookup score can be off for a query of length 1: the residual, and single precision
        scale = scale.astype(np.float32)
        long = np.linalg.norm(own.astype(np.float64), axis=2)[np.arange(len(own)), codes].sum(axis=1)
        off = np.linalg.norm(x - scale[:, None].astype(np.float64) * own[np.arange(len(own)), codes].sum(axis=1, dtype=np.float64), axis=1)
        off += np.finfo(np.float32).eps * (x.shape[1] + len(own) + 4) * scale * long
        packed = {"block": [group.column("block")[0].as_py()], "ids": [ids.tobytes()], "nth": [nth.tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()], "off": [off.tobytes()], "x": [x.tobytes()]}
        return pa.table({k: pa.array(v, pa.int64() if k == "block" else pa.binary()) for k, v in packed.items()})

    return run


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for d in range(q.shape[-1]):
        out += q[..., d] * x[..., d]
    return out


def _nearer(score: np.ndarray, ids: np.ndarray, new_score: np.ndarray, new_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of both, as many as there were before."""
    s, i = np.concatenate([score, new_score]), np.concatenate([ids, new_ids])
    top = np.lexsort((i, -s))[: len(score)]
    return s[top], i[top]


class Block:
    def __init__(self, row: dict, books: np.ndarray, dims: int, k: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        nth = read("nth", np.int64)
        keep = nth <= k  # the query itself may be among the first
        self.ids, self.scale, self.off = (read(c, t)[keep] for c, t in (("ids", np.int64), ("scale", np.float32), ("off", np.float64)))
        self.codes, self.x = read("codes", np.uint8).reshape(len(nth), -1)[keep], read("x", np.float64).reshape(-1, dims)[keep]
        self.slack = 4 * dims * np.finfo(np.float64).eps * np.linalg.norm(self.x, axis=1)
        self.books = books

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """(queries, rows) scores from the codes alone."""
        table = (self.books @ q.T.astype(np.float32)).astype(np.float32)  # levels, codes, queries
        near = np.zeros((len(self.ids), len(q)), np.float32)
        for m in range(len(self.books)):
            near += table[m][self.codes[:, m]]
        return np.ascontiguousarray((near * self.scale[:, None]).T)

    def reach(self, near: np.ndarray, size: float, one: np.ndarray, least: float) -> np.ndarray:
        """Rows whose exact score can be ``least`` or more."""
        c = np.flatnonzero(~(near + size * self.off < least))
        return c[~(self.x[c] @ one + size * self.slack[c] < least)]


def _search(books, queries, dims: int, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = queries.value
        score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        size = np.linalg.norm(q, axis=1)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({c: batch.column(c)[i].as_buffer() for c in batch.schema.names}, books.value, dims, k)
                r = min(rerank, len(block.ids))
                for lo in range(0, len(q), TOGETHER):
                    part = q[lo : lo + TOGETHER]
                    near = block.lookup(part)
                    for j, one in enumerate(part, lo):
                        if score[j, -1] == -np.inf:  # nothing to measure by yet
                            c = np.argpartition(-near[j - lo], r - 1)[:r]
                            c = c[block.ids[c] != qids[j]]
                            top = np.sort(exact_products(one, block.x[c]))[::-1][:k]
                            least = max(float(top[-1]) if len(top) == k else -np.inf, score[j, -1])
                        else:
                            least = score[j, -1]
                        c = block.reach(near[j - lo], size[j], one, least)
                        c = c[block.ids[c] != qids[j]]
                        if len(c):
                            score[j], found[j] = _nearer(score[j], found[j], exact_products(one, block.x[c]), block.ids[c])
        ok = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, ok.sum(axis=1))), pa.array(found[ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

    return run


def _vectors(df: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows, on the driver."""
    table = df.select("id", "v").toArrow()
    return table.column("id").to_numpy().astype(np.int64), np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(table), dims)


def _of_length(vectors: DataFrame, n: int, queries: DataFrame, asked: int, dims: int, k: int, sample: int, index_block: int, query_bytes: int, rerank: int, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    # by row, so that no row that is repeated often can be drawn as often
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))
    ids, some = _vectors(vectors.where(draw < int(min(1.0, sample / n) * (1 << 40))), dims)
    if len(ids) == 0:
        ids, some = _vectors(vectors.limit(1), dims)
    some = some[np.lexsort((*some.T[::-1], ids))][:sample]
    books = spark.sparkContext.broadcast(train(some))

    blocks = max(1, -(-n // index_block))
    index = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.lit(blocks)))
    index = index.repartition(blocks, "block").groupBy("block").applyInArrow(_pack_index(books), "block long, ids binary, nth binary, codes binary, scale binary, off binary, x binary")
    index = scratch.table(index, f"index-{dims}").drop("block")
    parts = max(1, -(-asked * dims * 8 // query_bytes))
    found = None
    for part in range(parts):
        own = spark.sparkContext.broadcast(_vectors(queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == part), dims))
        more = scratch.table(index.mapInArrow(_search(books, own, dims, k, rerank), "query_id long, vec_id long, score double"), f"found-{dims}-{part}")
        own.unpersist()
        found = more if found is None else found.union(more)
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, index_block: int = INDEX_BLOCK, query_bytes: int = QUERY_BYTES, rerank: int = RERANK) -> DataFrame:
    """For each row of ``queries`` (id, v) its ``k`` nearest of ``vectors`` (id, v): query_id, rank, vec_id, score.

    Nearness is the largest inner product in double precision; ties go to the smaller id; a query's own id doesn't
    count. Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of several lengths are searched among those of their own. Ids should be unique; of repeated rows each
    counts, repeated queries count once. With fewer than ``k`` candidates all are returned, and none for an empty
    table. Codebooks are trained on about ``sample`` vectors at most; all vectors are indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null").where(_usable("v"))
    vectors, queries = clean(vectors), scratch.table(clean(queries).dropDuplicates(), "queries")
    count = lambda df: {r.d: r.n for r in df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    sizes, asked = count(vectors), count(queries)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for d in sorted(set(sizes) & set(asked)):
        of = F.size("v") == d
        found = found.union(_of_length(vectors.where(of), sizes[d], queries.where(of), asked[d], d, k, sample, index_block, query_bytes, rerank, scratch))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
