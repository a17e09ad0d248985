"""The registered queries of this subpackage: name -> f(spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from . import ann, bpe, chat, decontam, langid, linedup, lm, minhash, quality, secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


#: A byte-level BPE vocabulary in the tokenizers library's format.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.load_spec(spark, vocabulary())
    out = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = langid.references(docs.where(remainder(4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), texts)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ann.nearest(vectors, vectors.where("id % 20 = 0"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.load_spec(spark, vocabulary())
    out = lm.score(_table(spark, sf_dir, "documents"), remainder(7) != 2, spec)
    return out.withColumn("held_out", remainder(7) == 2)


#: A document is rejected below this score.
ACCEPT = 0.3


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learns from the labels of documents outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").where(remainder(5) != 0)
    return quality.fit(_table(spark, sf_dir, "documents"), labels)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda which: F.expr(f"array_join(transform({which}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined("filter(spans, s -> s.kind <> 'entropy')").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Exact Jaccard by an inverted index of shingles, then the least id reachable.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, to_id) AS (
  SELECT doc_id, doc_id FROM words
  UNION
  SELECT r.id, e.b FROM reach r JOIN sym e ON e.a = r.to_id
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, w.doc_id = r.c AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id
JOIN (SELECT id, min(to_id) AS c FROM reach GROUP BY id) r ON r.id = w.doc_id
"""


#: Exact inner products, added up in the order of the components.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, x, ('0x' || substr(md5(x), 1, 12))::BIGINT AS h, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
cuts AS (
  SELECT *, w >= {linedup.LONG} OR lag(w) OVER d >= {linedup.LONG}
    OR (31 * coalesce(lag(h, 2) OVER d, 0) + lag(h) OVER d) % 1021 % {linedup.DIVISOR} = 0 AS cut
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM cuts),
chunks AS (
  SELECT doc_id, c, count(*) AS n, sum(w) AS w, string_agg(x, chr(10) ORDER BY i) AS t FROM numbered GROUP BY doc_id, c
),
ranked AS (SELECT *, CASE WHEN {linedup.ELIGIBLE} THEN row_number() OVER (PARTITION BY t ORDER BY doc_id, c) ELSE 1 END AS r FROM chunks)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::INTEGER AS n_lines, coalesce(x.removed, 0)::INTEGER AS n_removed, coalesce(x.t, '') AS text
FROM documents d JOIN (
  SELECT doc_id, sum(CASE WHEN r > 1 THEN n ELSE 0 END) AS removed, string_agg(t, chr(10) ORDER BY c) FILTER (r = 1) AS t FROM ranked GROUP BY doc_id
) x ON x.doc_id = d.doc_id
"""


#: Conversations as lists of turns, each prefix by its contents.
OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
),
pre AS (
  SELECT *, max(n) OVER (PARTITION BY conv_id) AS n_turns,
    md5(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY n)::VARCHAR) AS h
  FROM turns
),
kept AS (
  SELECT conv_id, n_turns FROM pre a WHERE n = n_turns
    AND NOT EXISTS (SELECT 1 FROM pre b WHERE b.n = a.n AND b.h = a.h AND (b.n_turns > a.n_turns OR b.n_turns = a.n_turns AND b.conv_id < a.conv_id))
)
SELECT conv_id, n_turns, p AS part, s AS text FROM (
  SELECT conv_id, n_turns, b, row_number() OVER (PARTITION BY conv_id ORDER BY b) AS p, s FROM (
    SELECT t.conv_id, k.n_turns, coalesce(floor(t.turn / 256), -1e18) AS b,
      string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.n) AS s
    FROM turns t JOIN kept k USING (conv_id) GROUP BY 1, 2, 3
  )
)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op4_ann_search": OP4_SQL, "op9_line_dedup": OP9_SQL, "op10_chat_format": OP10_SQL}
