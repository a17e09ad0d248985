"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of the last two lines decides where a chunk ends, so that an insertion moves only
the boundaries beside it; a line of ``LONG`` words or more is a chunk of its own, as it would be several lines in
a narrower layout. Chunks of several lines and at least ``LEAST`` words (or of ``LONG``) that occur more than once
anywhere are candidates. They are grouped by their hash and their bytes, which compares the bytes and, being an
aggregate, takes any number of copies; a hash that stands for different bytes is left alone. The occurrence in the
document with the least id, there the first, stays.

Chunks leave many passages in, as a boundary inside a passage or beside it decides what is compared. With ``passage``
given, every verbatim run of lines of more words goes too, at any line width: from each line the shortest window of
lines over that length is taken, forwards and backwards, and these windows together cover a run exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LONG = 30
LEAST = 20
#: A chunk ends after a line in so many, by its rolling hash.
DIVISOR = 2
#: Scripts without spaces: each of their characters counts as a word of a passage.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def line_chunks(text: str = "text") -> list[tuple[str, str]]:
    """Columns to add one after another: ``__l`` the lines, ``__s`` hash and words by line, ``__e`` the last lines
    of the chunks (from 1), ``__p`` their starts and numbers of lines, ``__c`` the chunks with lines n, words w and their bytes t."""
    words = "if(x = '', 0, length(x) - length(replace(x, ' ', '')) + 1)"
    rolling = "(31 * if(i = 1, 0L, __s[i - 2].h) + __s[i - 1].h) % 1021 % "
    return [
        ("__l", f"split(`{text}`, '\n', -1)"),
        ("__s", f"transform(__l, x -> named_struct('h', cast(conv(substring(md5(cast(x as binary)), 1, 12), 16, 10) as bigint), 'w', {words}))"),
        ("__e", f"filter(sequence(1, size(__s)), i -> i = size(__s) or __s[i - 1].w >= {LONG} or __s[i].w >= {LONG} or {rolling}{DIVISOR} = 0)"),
        ("__p", "transform(__e, (e, k) -> named_struct('start', if(k = 0, 1, __e[k - 1] + 1), 'n', if(k = 0, e, e - __e[k - 1])))"),
        (
            "__c",
            "transform(__p, c -> named_struct('n', c.n, 'w', aggregate(slice(__s, c.start, c.n), 0, (a, s) -> a + s.w),"
            " 't', array_join(slice(__l, c.start, c.n), '\n')))",
        ),
    ]


def line_windows(passage: int, text: str = "text") -> list[tuple[str, str]]:
    """Columns to add one after another: ``__l`` the lines, ``__v`` those with words, ``__a`` the windows: lines i
    to j (from 1) of more than ``passage`` words, the shortest from each line on and the shortest up to each line,
    with the md5 of their bytes. Blank lines count inside a window only."""
    words = rf"size(regexp_extract_all(x, r'(?U)[{UNSPACED}]|[^\s{UNSPACED}]+', 0))"
    step = f"if(a.w > {passage}, a, named_struct('w', a.w + x, 'n', a.n + 1))"
    reach = lambda of: f"transform({of}, (_, k) -> aggregate(slice({of}, k + 1, {passage + 1}), named_struct('w', 0, 'n', 0), (a, x) -> {step}, a -> if(a.w > {passage}, a.n, 0)))"
    window = lambda lo, hi: f"if(n = 0, null, named_struct('i', __v[{lo}].i, 'j', __v[{hi}].i))"
    return [
        ("__l", f"split(`{text}`, '\n', -1)"),
        ("__v", f"filter(transform(__l, (x, i) -> named_struct('i', i + 1, 'w', {words})), v -> v.w > 0)"),
        ("__f", "transform(__v, v -> v.w)"),
        ("__b", "reverse(__f)"),
        ("__f", reach("__f")),
        ("__b", reach("__b")),
        ("__a", f"concat(transform(__f, (n, k) -> {window('k', 'k + n - 1')}), transform(__b, (n, k) -> {window('size(__v) - k - n', 'size(__v) - k - 1')}))"),
        ("__a", "transform(array_distinct(filter(__a, a -> a is not null)), a -> named_struct('i', a.i, 'j', a.j,"
         " 'h', unhex(md5(cast(array_join(slice(__l, a.i, a.j - a.i + 1), '\n') as binary)))))"),
    ]


ELIGIBLE = f"(n > 1 and w >= {LEAST} or w >= {LONG})"


def _with(df: DataFrame, name: str, expr: str) -> DataFrame:
    """``df`` with a column that is computed once by row: the optimiser doesn't copy it into later lambdas, where
    it would be computed for each element."""
    return df.select(*[f"`{c}`" for c in df.columns if c != name], F.expr(f"explode(array({expr}))").alias(name))


def _chunked(df: DataFrame, text: str) -> DataFrame:
    for name, expr in line_chunks(text):
        df = _with(df, name, expr)
    return df


def _repeated(docs: DataFrame, passage: int) -> DataFrame:
    """For each ``__k`` of ``docs`` (__k, __t) with repeated windows ``__runs``: hash of the text, lines i to j that go."""
    df = docs.withColumn("__x", F.xxhash64("__t"))
    for name, expr in line_windows(passage, "__t"):
        df = _with(df, name, expr)
    windows = df.select("__k", "__x", F.explode("__a").alias("a")).select("__k", "__x", "a.i", "a.j", "a.h")
    first = windows.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct("__k", "__x", "i", "j")).alias("first")).where("m > 1").drop("m")
    found = windows.join(first.hint("merge"), "h")
    # in the first occurrence's own text, only what begins behind it
    found = found.where("__k <> first.__k or __x <> first.__x or i > first.j")
    return found.groupBy("__k").agg(F.collect_list(F.struct(F.col("__x").alias("x"), "i", "j")).alias("__runs"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", passage: int | None = None) -> DataFrame:
    """``docs`` with repeated chunks of lines removed from ``text``; adds ``n_lines`` and ``n_removed`` (lines).

    Rows and other columns stay as they are (columns called n_lines or n_removed are replaced). A text whose lines
    all go becomes empty; null stays null with 0 lines, an empty text has one empty line. Rows without ``key`` are
    neither changed nor compared; rows that share a key count as one document and are cleaned alike.

    With ``passage`` every run of lines with more than so many words goes as well that stands verbatim in a document
    of smaller key, or before it in the same one; different texts of one key are then compared like documents. Words
    are parted by white space of any kind, and characters of unspaced scripts count one each. A line that goes always
    has an equal one that stays.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    text, key = f"c{names.index(text)}", f"c{names.index(key)}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # so that no name meets one of the columns made here
    texts = docs.where(f"`{key}` is not null").select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("__t"))
    chunks = _chunked(texts, "__t")
    chunks = chunks.select("__k", F.explode("__c").alias("c")).select("__k", "c.n", "c.w", "c.t").where(ELIGIBLE)
    chunks = chunks.select("__k", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(17), F.col("t")).alias("h2"), "t")

    same = chunks.groupBy("h1", "h2", "t").agg(F.count("*").alias("m"), F.min("__k").alias("first"))
    same = same.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.sum("m").alias("m"), F.min("first").alias("first"))
    same = same.where("texts = 1 and m > 1").select("h1", "h2", "first")
    found = chunks.select("__k", "h1", "h2").join(same.hint("merge"), ["h1", "h2"])
    chunk = F.struct("h1", "h2")
    actions = found.groupBy("__k").agg(
        F.collect_set(F.when(F.col("__k") != F.col("first"), chunk)).alias("__drop"), F.collect_set(F.when(F.col("__k") == F.col("first"), chunk)).alias("__once")
    )

    if passage:
        actions = actions.join(_repeated(texts, passage).hint("merge"), "__k", "full")
        empty = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
        actions = actions.withColumn("__drop", F.coalesce("__drop", empty)).withColumn("__once", F.coalesce("__once", empty))
    out = docs.join(actions.hint("merge"), docs[key] == actions["__k"], "left").drop("__k")
    out = out.withColumn("__work", F.when(F.col("__drop").isNotNull(), F.col(f"`{text}`")))
    out = _chunked(out, "__work")
    out = _with(out, "__h", "transform(__c, c -> named_struct('h1', xxhash64(c.t), 'h2', xxhash64(17, c.t)))")
    gone = "array_contains(__drop, __h[k]) or array_contains(__once, __h[k]) and array_position(__h, __h[k]) < k + 1"
    if passage:
        out = _with(out, "__g", f"filter(__p, (c, k) -> {gone})")
        out = _with(out, "__x", "xxhash64(__work)")
        ranges = "transform(__g, c -> sequence(c.start, c.start + c.n - 1)), transform(filter(coalesce(__runs, array()), r -> r.x = __x), r -> sequence(r.i, r.j))"
        out = _with(out, "__r", f"transform(array_except(sequence(1, size(__l)), flatten(concat({ranges}))), i -> named_struct('n', 1, 't', __l[i - 1]))")
    else:
        out = _with(out, "__r", f"filter(__c, (c, k) -> not ({gone}))")
    lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(F.split(F.col(f"`{text}`"), "\n", -1)))
    out = out.withColumn("n_lines", lines)
    out = out.withColumn("n_removed", F.coalesce(F.expr("size(__l) - aggregate(__r, 0, (a, c) -> a + c.n)"), F.lit(0)))
    out = out.withColumn(text, F.coalesce(F.expr("array_join(transform(__r, c -> c.t), '\n')"), F.col(f"`{text}`")))
    return out.select(*docs.columns, "n_lines", "n_removed").toDF(*names, "n_lines", "n_removed")
