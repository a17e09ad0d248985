"""The whole job, where a cut would show: planted rows that the first version of an operator left in or out."""

import copy
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from framelake.llm import ann, bpe, decontam, lm, minhash, queries as Q, textnum as tn
from framelake.llm.store import Scratch


def _passage(width, n, tag):
    return [" ".join(f"{tag}{k}x{j}" for j in range(width)) for k in range(n)]


def test_pipeline_passages_of_any_width(spark, sf_dir):
    import corpus_pipeline

    rows, kept, gone = [], {}, {}
    for width in range(5, 30):
        lines = _passage(width, 51 // width + 1, f"p{width}w")
        for copy in range(3):
            i = 100 * width + copy
            edge = [f"edge {i} {s} alone" for s in ("a", "b")]
            rows.append((i, "\n".join([edge[0], *lines, edge[1]])))
            kept[i], gone[i] = edge, lines if copy else []
    mixed = _passage(12, 1, "m") + [""] + _passage(26, 1, "n") + _passage(17, 1, "o")
    tabs = "\t".join(f"tab{k}" for k in range(60))
    han = "".join(chr(0x4E00 + 7 * k) for k in range(80))
    rows += [(5000, "\n".join(mixed)), (5001, "\n".join(["before this", *mixed, "after that"]))]
    rows += [(5002, f"one\n{tabs}\n{han}"), (5003, f"{han}\ntwo\n{tabs}")]
    # of one id, texts that differ; in one text, a passage twice
    twice = "\n".join(_passage(10, 6, "q"))
    rows += [(6000, f"own\n{twice}\nmid\n{twice}"), (6001, "fine"), (6001, f"x\ny\nz\nlast\n{twice}")]
    out = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    got = [(r.doc_id, r.text) for r in out.collect()]
    by = dict(got)
    for i, edge in kept.items():
        lines = by[i].split("\n")
        assert [x for x in lines if x in edge] == edge
        assert (len(lines) == 2) == bool(gone[i])
    assert by[5000] == "\n".join(mixed) and by[5001] == "before this\nafter that"
    assert by[5002] == f"one\n{tabs}\n{han}" and by[5003] == "two"
    assert by[6000] == f"own\n{twice}\nmid" and {t for i, t in got if i == 6001} == {"fine", "x\ny\nz\nlast"}


def test_op5_learns_beyond_the_first_sample(spark):
    """A word order that the 300 documents with the least hash don't have is learned from the others."""
    rng = np.random.default_rng(0)
    ids = [r.doc_id for r in spark.range(2000).toDF("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    names = np.array("red green blue black white grey pink gold".split())
    text = lambda k: " ".join(rng.choice(names, 100) if k < lm.SAMPLE else names[(np.arange(100) + k) % 8])
    docs = spark.createDataFrame([(i, text(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    out = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, F.lit(True), bpe.load_spec(spark, Q.vocabulary())).collect()}
    assert np.mean([out[i] for i in ids[lm.SAMPLE :]]) > -0.7, np.mean([out[i] for i in ids[lm.SAMPLE :]])


def test_op4_near_copies_beyond_rerank(spark):
    """Each query's nearest are exact in blocks much larger than RERANK, a third of them near copies."""
    for noise in (0.1, 0.01, 0.001):
        rng = np.random.default_rng(4)
        x = rng.standard_normal((6000, 64))
        x[::3] = x[0] + noise * rng.standard_normal((2000, 64))
        v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
        got = {}
        for r in ann.nearest(v, v.where("id % 50 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = {0: [], 1: []}
        for q in range(0, 6000, 50):
            s = x @ x[q]
            s[q] = -np.inf
            hits[q % 3 == 0].append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
        print("noise", noise, "recall@20: near copies", np.mean(hits[1]), "others", np.mean(hits[0]))
        assert min(hits[0] + hits[1]) == 1


def doubled(n, a="ab", b="ba"):
    """Two words of ``n`` letters that every polynomial modulo a power of two hashes alike."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_are_told_apart_by_their_bytes(spark):
    """Pairs of words that collide under any polynomial hash modulo 2**64 stay apart in op1, op2 and op8."""
    from tokenizers import Tokenizer

    pairs = [doubled(n) for n in (1024, 2048, 4096)]
    rows = [(2 * k + j, f"{w} and then some more words {k}") for k, pair in enumerate(pairs) for j, w in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {i for i, _ in rows}
    tok = Tokenizer.from_file(Q.vocabulary())
    spec = bpe.load_spec(spark, Q.vocabulary())
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.round_trip(docs.coalesce(1), spec).collect()}
    assert got == {i: (tok.encode(t, add_special_tokens=False).ids, t) for i, t in rows}
    items = spark.createDataFrame([(f"i{k}", f"{a} {a} {a}") for k, (a, _) in enumerate(pairs)], "item_id string, text string")
    other = spark.createDataFrame([(k, f"{b} {b} {b}") for k, (_, b) in enumerate(pairs)], "doc_id long, text string")
    assert all(not r.item_ids and not r.spans for r in decontam.find_items(other, items).collect())


def test_op1_texts_that_share_an_id(spark):
    """Each text of a shared doc_id is compared; large buckets of unlike members keep all their links."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    x, y = word(60), word(60)
    rows = [(5, " ".join(x)), (5, " ".join(y)), (5, " ".join(y)), (9, " ".join(y[:-1])), (3, " ".join(x[1:])), (7, None), (7, "")]
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in out.items()} == {5: 3, 9: 3, 3: 3, 7: 7} and out[5].n_shingles == 56 and out[7].n_shingles == 0
    common = word(40)  # each pair shares about half of its shingles, and some pairs most of them
    rows = []
    for k in range(700):
        own = word(28)
        rows += [(3 * k, " ".join(common + own)), (3 * k + 1, " ".join(common + own[:-2])), (3 * k + 2, " ".join(common + own[:-4]))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 3 for i, _ in rows}


def test_op5_texts_without_known_words(spark):
    """A task whose chunk has no broadcast word, a partition of null texts, and an empty fold."""
    spec = bpe.load_spec(spark, Q.vocabulary())
    rows = [(k, f"some words of number {k % 3}") for k in range(30)] + [(100 + k, None) for k in range(10)] + [(200, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    out = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 200, spec, sample=10, steps=5, hot=2).collect()}
    assert len(out) == 41 and out[100].n_tokens == 1 and out[200].n_known == 1 and all(np.isfinite(r.score) for r in out.values())
    none = lm.score(docs, F.lit(False), spec, steps=5).collect()
    assert len(none) == 41 and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in none)
    assert lm.score(docs.limit(0), F.lit(True), spec, steps=5).count() == 0


def _stage_tables(spark, at, docs, sf_dir):
    docs.write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def _lines_brute(texts):
    """What line dedup leaves of {id: text}: repeated chunks, and verbatim runs of over 50 words, by comparing texts."""
    import hashlib

    count = lambda x: 0 if x == "" else x.count(" ") + 1
    words = lambda x: len(x.split())
    chunks = {}
    for i, text in texts.items():
        lines, out, begin = text.split("\n"), [], 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines]
        w = [count(x) for x in lines]
        for k in range(len(lines)):
            last = k + 1 == len(lines)
            if last or w[k] >= 30 or w[k + 1] >= 30 or (31 * (h[k - 1] if k else 0) + h[k]) % 1021 % 2 == 0:
                out.append((begin, k + 1))
                begin = k + 1
        chunks[i] = out
    gone = {i: set() for i in texts}
    seen = set()
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for a, b in chunks[i]:
            t, w = "\n".join(lines[a:b]), sum(count(x) for x in lines[a:b])
            if (b - a > 1 and w >= 20) or w >= 30:
                if t in seen:
                    gone[i] |= set(range(a, b))
                seen.add(t)
    # every run of lines, from one with words to one with words, that stands in a smaller document or before in this one
    places = {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for a, x in enumerate(lines):
            places.setdefault(x, []).append((i, a))
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for a in range(len(lines)):
            for j, b in places[lines[a]]:
                if (j, b) >= (i, a) or (j == i and b == a):
                    continue
                other, n = texts[j].split("\n"), 0
                while a + n < len(lines) and b + n < len(other) and lines[a + n] == other[b + n] and (j != i or b + n < a):
                    n += 1
                while n and not lines[a + n - 1].split():
                    n -= 1
                if n and lines[a].split() and sum(words(x) for x in lines[a : a + n]) > 50:
                    gone[i] |= set(range(a, a + n))
    return {i: ("\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone[i]), len(gone[i])) for i in texts}


def test_pipeline_by_brute_force(spark, sf_dir, tmp_path):
    """All five stages against versions that compare everything with everything."""
    import re

    import corpus_pipeline
    from tokenizers import Tokenizer

    out = {(r.doc_id, r.text): bytes(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in Q.op6_quality_classifier(spark, sf_dir).collect()}  # held against brute force in its own test
    texts = _lines_brute({i: t for i, t in docs.items() if scores[i] >= Q.ACCEPT})
    texts = {i: t for i, (t, n) in texts.items() if not (n and not t.strip(" "))}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    texts = {i: t for i, t in texts.items() if find(i) == i}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = split(r.text or "")
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    leaks = {i for i, t in texts.items() for n in sizes if any(tuple(w[k : k + n]) in windows for w in [split(t)] for k in range(len(w) - n + 1))}
    tok = Tokenizer.from_file(Q.vocabulary())
    want = {(i, t): np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in texts.items() if i not in leaks}
    assert len(want) > 50 and out == want


def test_pipeline_awkward(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, shared ids, clashing columns, a long text and an empty table."""
    import corpus_pipeline

    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(1, None), (2, ""), (3, "alone here with a few words"), (3, "alone here with a few words"), (4, "one text of an id"), (4, "another text of it that differs"), (None, "no id at all here"), (None, None), (5, "many " * 30000)]
    rows = spark.createDataFrame([(i if i is None else 10**6 + i, t, None, None, None) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
    for name in ("__score", "__id", "__nth", "n_lines", "n_removed", "__k", "__source"):
        docs = docs.withColumn(name, F.lit("x"))
    at = _stage_tables(spark, tmp_path / "a", docs, sf_dir)
    current = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, at)
        assert current.columns == docs.columns and current.where("__score <> 'x' or n_lines <> 'x' or __nth <> 'x'").count() == 0
        current = corpus_pipeline.Scratch(spark).table(current, "t")
    left = current.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    assert left.count() == 0
    out = corpus_pipeline.tokenize(spark, current, at).collect()
    ids = [r.doc_id for r in out if r.doc_id and r.doc_id > 10**6]
    assert sorted(ids) == sorted({10**6 + k for k in (1, 2, 3, 4, 5)} & set(ids)) and {10**6 + 3, 10**6 + 4} <= set(ids)
    none = _stage_tables(spark, tmp_path / "b", docs.limit(0), sf_dir)
    assert corpus_pipeline.run(spark, none).count() == 0


def test_op5_learns_from_the_whole_fold(spark):
    """A word order that only documents outside any 2,048 (drawn by hash) have is learned, and each window trains once."""
    rng = np.random.default_rng(0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(2048 / 3000 * (1 << 30))
    first = {r.doc_id for r in spark.range(3000).toDF("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(lm.SAMPLE).collect()}
    plain = {r.doc_id for r in spark.range(3000).toDF("doc_id").where(drawn).collect()} | first
    names = np.array("red green blue black white grey pink gold".split())
    text = lambda i: " ".join(rng.choice(names, 100) if i in plain else names[(np.arange(100) + i) % 8])
    docs = spark.createDataFrame([(i, text(i)) for i in range(3000)], "doc_id long, text string")
    out = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, F.lit(True), bpe.load_spec(spark, Q.vocabulary())).collect()}
    rest = [out[i] for i in range(3000) if i not in plain]
    assert len(rest) > 500 and np.mean(rest) > np.mean([out[i] for i in plain]) + 0.2, (np.mean(rest), np.mean([out[i] for i in plain]))


def test_op5_gradient():
    """The gradient of the weights against differences of the loss, masks and repeated inputs included."""
    rng = np.random.default_rng(1)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 200).astype(float)))
    for n, w in model.p.items():
        model.p[n] = (w + rng.standard_normal(w.shape) * 0.1).astype(np.float64)
    ids = rng.integers(0, 199, 70)
    at = np.array([0, 3, 3, 45, 70])
    text, k = model.blocks(at)
    inputs, target, scored = model.windows(np.append(ids, 0), at, text, k)
    classes = model.shape.of[target]
    g = {n: np.zeros_like(w) for n, w in model.p.items()}
    model.gradient(inputs, classes, scored, 1.0, g)
    loss = lambda: -np.log(10) * model.score(ids, at, model.tables()).sum()
    for n, w in model.p.items():
        place = tuple(x[0] for x in np.nonzero(np.abs(g[n]) == np.abs(g[n]).max()))
        old = w[place]
        w[place] = old + 5e-3
        up = loss()
        w[place] = old - 5e-3
        down = loss()
        w[place] = old
        assert abs((up - down) / 1e-2 - g[n][place]) < 0.02 * max(1, abs(g[n][place])), n


def test_op5_changes_of_many_shards(spark, monkeypatch):
    """The weights move by the mean of all shards' changes by their windows, summed in more than one round."""
    rng = np.random.default_rng(2)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 300).astype(float)))
    docs = [(i, rng.integers(0, 299, rng.integers(0, 60)).astype("<u2").tobytes()) for i in range(900)]
    fold = spark.createDataFrame([(i, bytearray(d)) for i, d in docs], "doc_id long, ids binary")
    monkeypatch.setattr(lm, "SHARD", 256)
    subwords = sum(len(d) // 2 + 1 for _, d in docs)
    shards = round(subwords / lm.SHARD)
    assert shards > lm.FAN
    by: dict = {}
    for r in fold.select(F.pmod(F.xxhash64("doc_id", "ids", F.lit(13)), F.lit(shards)).alias("shard"), "ids").collect():
        by.setdefault(r.shard, []).append(bytes(r.ids))
    want, windows = 0.0, 0
    for texts in by.values():
        own = copy.deepcopy(model)
        n = own.train(*lm._joined(sorted(texts), 300), steps=None)
        want, windows = want + (own.flat() - model.flat()) * n, windows + n
    before = model.flat()
    lm._train_on_fold(model, fold, subwords)
    assert windows == sum(-(-(len(d) // 2 + 1) // lm.STRIDE) for _, d in docs)
    assert np.abs(want).max() > 0 and np.allclose(model.flat() - before, want / windows, atol=1e-5)


def test_op8_index_in_bounded_blocks(spark):
    """A task's shards are written and read one at a time, not as one block of all; the rows are those of small shards."""
    rng = np.random.default_rng(5)
    names = np.array([f"w{k}" for k in range(5000)])
    docs = [(i, " ".join(rng.choice(names, 20000))) for i in range(100)]
    items = spark.createDataFrame([("a", " ".join(docs[70][1].split()[500:515])), ("b", "w1 w2 nowhere")], "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    scratch = Scratch(spark)
    index = decontam.build_index(table, scratch)
    groups = [g for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) >= 3 and max(g.total_byte_size for g in groups) < 2 * decontam.SHARD, [g.total_byte_size for g in groups]
    found = {r.doc_id: r for r in decontam.search(index, items, scratch).collect()}
    assert len(found) == 100 and [tuple(s) for s in found[70].spans] == [(500, 515)] and found[70].item_ids == ["a"]
    assert all(not r.item_ids for i, r in found.items() if i != 70)


def test_op5_counted_pairs(spark):
    """The logits of an input and the class behind it are counted over all texts, and training leaves them."""
    rng = np.random.default_rng(6)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 300).astype(float)))
    shape, c = model.shape, lm.SINGLE + lm.SHARED
    docs = [rng.integers(0, 299, n) for n in (0, 1, 2, 40, 300, 0, 5)]
    want = np.zeros((shape.inputs, c))
    for d in docs:
        for a, b in zip([None, *d], [*d, 299], strict=True):
            want[shape.inputs - 1 if a is None else shape.input[a], shape.of[b]] += 1
    assert want.sum() == 348 + len(docs)
    rows = [(i, bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)]
    fold = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3)
    lm._count_on_fold(model, fold)
    prior = np.exp(shape.prior.astype(float))
    assert np.allclose(np.exp(model.p["B"]) * prior, (want + lm.PRIOR * prior) / (want.sum(axis=1, keepdims=True) + lm.PRIOR), rtol=1e-4)
    counted, size = model.p["B"].copy(), sum(w.size for w in model.p.values())
    assert model.train(*lm._joined([bytes(r) for _, r in rows], 300), steps=None) and len(model.flat()) == size - counted.size
    lm._train_on_fold(model, fold, 355)
    assert (model.p["B"] == counted).all()
    lm._count_on_fold(model, fold.limit(0))
    assert np.abs(model.p["B"]).max() < 1e-5


def test_op5_own_words():
    """Words by text with their numbers, of which one may take several entries, and the texts' words as a whole."""
    texts = [b"", b"b a b c a", b"x " * 150_000 + b"a", b"", b"a"]
    words = tn.Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    h, times, at, every, which = lm._own_words(words)
    assert times.max() == 0xFFFF and len(set(every.tolist())) == len(every) == 4 and (every[which] == h).all()
    for k, t in enumerate(texts):
        got: dict = {}
        for x, n in zip(h[at[k] : at[k + 1]].tolist(), times[at[k] : at[k + 1]].tolist(), strict=True):
            got[x] = got.get(x, 0) + n
        own = tn.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])).hash.tolist()
        assert got == dict(Counter(own))


def test_op5_scores_of_large_weights():
    """Scores where the logits' bound is beyond what an exponential takes, and where they are: as by float64 and plain masks."""
    rng = np.random.default_rng(7)
    ids, at = rng.integers(0, 199, 400), np.array([0, 0, 5, 90, 400])
    for scale in (1.0, 40.0):
        model = lm.Attention(lm.Shape(rng.integers(0, 50, 200).astype(float)))
        model.p["B"] = (rng.standard_normal(model.p["B"].shape) * scale).astype(np.float32)
        model.p["V"] *= 3
        tables = model.tables()
        got = model.score(ids, at, tables)
        wide = {n: t.astype(np.float64) for n, t in tables.items()}
        wide["Z"] = wide["Z"] + 61  # a shift of all logits changes no probability, but the way they are summed up
        assert np.isfinite(got).all() and np.allclose(got, model.score(ids, at, wide), rtol=1e-4)


def test_op5_places():
    """Hashes are found among sorted ones, also where many start alike, at both ends and among none."""
    rng = np.random.default_rng(8)
    some = np.unique(np.concatenate([rng.integers(0, 1 << 64, 1000, np.uint64), np.arange(50, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(50, dtype=np.uint64)]))
    h = rng.permutation(np.concatenate([some, some[::3], rng.integers(0, 1 << 64, 500, np.uint64), np.arange(40, 90, dtype=np.uint64)]))
    for hashes in (some, some[:0]):
        begin = np.searchsorted(hashes >> np.uint64(64 - lm.TOP), np.arange((1 << lm.TOP) + 1, dtype=np.uint64))
        where = {x: k for k, x in enumerate(hashes.tolist())}
        assert lm._places(hashes, begin, h).tolist() == [where.get(x, -1) for x in h.tolist()]


def test_op5_windows_without_gaps():
    """Windows that are all full are those of the general way, the end of a text included."""
    rng = np.random.default_rng(9)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 200).astype(float)))
    ids, at = np.append(rng.integers(0, 199, 500), 0), np.array([0, 95, 218, 500])  # the first text ends where a window does
    text, k = model.blocks(at)
    order = model.full_first(at, text, k)
    text, k = text[order], k[order]
    every = model.windows(ids, at, text, k)
    full = (every[0] >= 0).all(axis=1)
    n = int(full.sum())
    assert full[:n].all() and n >= 15 and any((t == 199).any() for t in every[1][:n])
    for x, y in zip(every, model.windows(ids, at, text[:n], k[:n]), strict=True):
        assert (x[:n] == y).all()


def test_op5_merges_a_pretoken_once(spark, monkeypatch):
    """What a worker merged in one segment isn't merged in the next, and ids are those of merging all: also where hashes are equal."""
    vocab = bpe._encoder(bpe.load_spec(spark, Q.vocabulary()).value).vocab
    rng = np.random.default_rng(10)
    words = [bytes(rng.integers(97, 123, n, np.uint8)) for n in [0, *rng.integers(1, 30, 300), 47, 48, 49, 500]]
    words = list(dict.fromkeys(words))
    merged, plain = [], bpe.Vocabulary.merge
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda own, data, edges: merged.append(len(edges) - 1) or plain(own, data, edges))

    def check(known, picked):
        data, edges = np.frombuffer(b"".join(picked), np.uint8), np.cumsum([0, *map(len, picked)])
        ids, n = known.merge(vocab, data, edges[:-1], edges[1:])
        want = plain(vocab, data, edges)
        assert (ids == want[0]).all() and (n == want[1]).all()

    known = bpe.Known(10_000)
    for picked in (words[:200], words[100:], words, words[::-1], words[:0]):
        check(known, picked)
    long = sum(len(w) > known.LONGEST for w in words)
    assert merged == [200, len(words) - 200, 1 + long, 1 + long, 0]  # the empty one and the long ones aren't kept
    few = bpe.Known(50)
    for _ in range(3):
        check(few, words)
    assert len(few.hashes) == 50 and merged[-2:] == [len(words) - 50] * 2
    hashes = tn.hashes
    monkeypatch.setattr(tn, "hashes", lambda *a: hashes(*a) & np.uint64(7))
    clash = bpe.Known(10_000)
    for picked in (words[:200], words[100:], words):
        check(clash, picked)
    # by whole texts: the second segment merges nothing that the first had
    monkeypatch.setattr(tn, "hashes", hashes)
    monkeypatch.setattr(lm, "SEGMENT", 1)
    merged.clear()
    spec = type("Spec", (), {"value": bpe.load_spec(spark, Q.vocabulary()).value})
    lm._pretokens.clear()
    table = pa.table({"key": [0, 1], "doc_id": [0, 1], "train": [True, True], "text": ["one two three", "three one two"]})
    ids = [x.as_py() for b in lm._read(spec)(iter(table.to_batches(max_chunksize=1))) for x in b.column(5) if x.is_valid]
    encoder = bpe._encoder(spec.value)
    assert [list(np.frombuffer(x, "<u2")) for x in ids] == [list(encoder(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in (b"one two three", b"three one two")]
    assert merged[:2] == [3, 2]  # "three" and " one" are other pretokens than " three" and "one"


def test_op5_windows_by_hand():
    """Windows of which the first ones lack nothing and the others do, place by place."""
    rng = np.random.default_rng(11)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 200).astype(float)))
    ids, at = rng.integers(0, 199, 300), np.array([0, 0, 95, 96, 218, 300])
    text, k = model.blocks(at)
    order = model.full_first(at, text, k)
    for text, k in ((text, k), (text[order], k[order]), (text[:0], k[:0])):
        inputs, target, scored = model.windows(np.append(ids, 0), at, text, k)
        assert inputs.shape == (len(k), lm.WINDOW) and target.shape == scored.shape == (len(k), lm.STRIDE)
        for row, (t, b) in enumerate(zip(text, k, strict=True)):
            own = [*ids[at[t] : at[t + 1]], 199]
            for j in range(lm.WINDOW):
                place = b * lm.STRIDE - lm.OVERLAP + j
                there = 0 <= place < len(own)
                assert inputs[row, j] == (-1 if not there else model.shape.inputs - 1 if not place else model.shape.input[own[place - 1]])
                if j >= lm.OVERLAP:
                    assert scored[row, j - lm.OVERLAP] == there and (not there or target[row, j - lm.OVERLAP] == own[place])


def test_op5_gradient_of_large_weights():
    """Where attention is beyond its bounds in some windows, the gradient is that of bounded attention, written out in float64."""
    rng = np.random.default_rng(12)
    model = lm.Attention(lm.Shape(rng.integers(0, 50, 200).astype(float)))
    ids, at = np.append(rng.integers(0, 199, 400), 0), np.array([0, 400])
    text, k = model.blocks(at)
    inputs, target, scored = (x[1:-1] for x in model.windows(ids, at, text, k))
    classes = model.shape.of[target]
    for scale in (1, 3000, 20):
        p = {n: w.astype(np.float64) for n, w in model.p.items()}
        p["Q"] *= scale
        model.p = {n: w.astype(np.float32) for n, w in p.items()}
        g = {n: np.zeros_like(w) for n, w in model.p.items() if n != "B"}
        with np.errstate(over="ignore", invalid="ignore"):
            model.gradient(inputs, classes, scored, 1.0, g)
        x = p["E"][inputs] + p["P"]
        own = x[:, lm.OVERLAP :]
        raw = (own @ p["Q"]) @ (x @ p["K"]).transpose(0, 2, 1) / 4
        a = np.exp(np.clip(raw, -30, 30)) * lm._CAUSAL
        a /= a.sum(axis=2, keepdims=True)
        h = a @ (x @ p["V"]) + own
        z = np.exp(h @ p["U"] + p["b"] + p["B"][inputs[:, lm.OVERLAP :]])
        z /= z.sum(axis=2, keepdims=True)
        dz = z - np.eye(z.shape[2])[classes]
        dh = dz @ p["U"].T
        da = dh @ (x @ p["V"]).transpose(0, 2, 1)
        ds = a * (da - (a * da).sum(axis=2, keepdims=True)) / 4
        want = {"b": dz.sum(axis=(0, 1)), "U": np.einsum("nih,nic->hc", h, dz), "V": np.einsum("njh,nij,nik->hk", x, a, dh), "Q": np.einsum("nih,nij,njk->hk", own, ds, x @ p["K"]), "K": np.einsum("njh,nij,nik->hk", x, ds, own @ p["Q"])}
        assert (np.abs(raw).max() > 30) == (scale > 1), (scale, np.abs(raw).max())
        for n, w in want.items():
            assert np.allclose(g[n], w, rtol=2e-3, atol=2e-3 * np.abs(w).max()), (scale, n)
