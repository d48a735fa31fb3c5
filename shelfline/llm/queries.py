"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import decontaminate, jaccard_join, langid, license_scan, merkle, quality, ring, sentencepiece, topk, toxicity, training_order, warc, whitening

#: Vocabulary file of the encoding queries; read where the query is made.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """Fold of a document: its id's CRC-32, as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM r
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, remainder(5) != 0)
    return langid.identify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id>.txt."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    path = F.concat(F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    found = license_scan.scan(docs.select(path.alias("path"), "text"))
    doc_id = F.regexp_extract("path", r"([-0-9]+)\.txt$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), "licence", "how", "folder")


def _op3_sql() -> str:
    rows, idf, other = license_scan.weights()
    values = lambda table: ", ".join(f"({', '.join(f'{x!r}e0' if isinstance(x, float) else repr(x) for x in row)})" for row in table)
    stop = ", ".join(f"'{w}'" for w in license_scan.STOP_WORDS)
    return f"""
WITH f AS (
  SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder, source AS top, text FROM documents WHERE doc_id IS NOT NULL
),
vec(template, licence, term, share) AS (VALUES {values(rows)}),
known(term, idf) AS (VALUES {values(sorted(idf.items()))}),
seg AS (
  SELECT doc_id, line, seg FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS seg, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f)
  UNION ALL SELECT doc_id, -1, text FROM f WHERE text IS NOT NULL
),
tf AS (
  SELECT doc_id, line, term, count(*) AS tf FROM (
    SELECT doc_id, line, unnest(regexp_extract_all(translate(seg, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.TERM}')) AS term FROM seg
  ) WHERE term NOT IN ({stop}) GROUP BY ALL
),
w AS (SELECT doc_id, line, tf.term, tf * coalesce(idf, {other!r}e0) AS w FROM tf LEFT JOIN known USING (term)),
len AS (SELECT doc_id, line, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
sc AS (
  SELECT doc_id, line, licence, round(dot / length, 9) AS score
  FROM (SELECT doc_id, line, template, licence, sum(w * share) AS dot FROM w JOIN vec USING (term) GROUP BY ALL) JOIN len USING (doc_id, line)
),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, licence) = 1),
good AS (
  SELECT doc_id, licence, score, CASE WHEN line >= 0 THEN 'header' ELSE 'file' END AS how, folder, doc_id || '.txt' AS name
  FROM best JOIN f USING (doc_id)
  WHERE (line >= 0 AND score >= {license_scan.THRESHOLD}) OR (line = -1 AND score >= {license_scan.FILE_THRESHOLD})
),
own AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY how DESC, score DESC, licence) = 1),
dirs AS (SELECT folder, licence FROM good WHERE how = 'file' QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, name) = 1)
SELECT f.doc_id, coalesce(own.licence, dirs.licence) AS licence,
  CASE WHEN own.licence IS NOT NULL THEN own.how WHEN dirs.licence IS NOT NULL THEN 'inherited' END AS how,
  CASE WHEN own.licence IS NOT NULL OR dirs.licence IS NOT NULL THEN f.folder END AS folder
FROM f LEFT JOIN own ON f.doc_id = own.doc_id LEFT JOIN dirs ON f.folder = dirs.folder
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.score(docs, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(spark, table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), sentencepiece.Vocabulary.load(TOKENIZER))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS_6 = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP6_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_6} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
),
hits AS (
  SELECT p.r, p.i, p.m, win.item
  FROM (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
  ) p JOIN win ON p.m = win.m AND p.s = win.s
),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(its.items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(its.items, ','), '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build(table(spark, sf_dir, "documents"), merkle.tampered_leaf())
    return merkle.report(merkle.proofs(manifest))


#: CRC-32 of a short ASCII text, bit by bit: -1 stands for a shift.
_CRC32 = (
    "xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295)"
)


def _op11_sql(heights: int = 5, top_heights: int = 3) -> str:
    """Levels as tables: a tree of one node stays as it is from level to level."""
    fields = lambda text: " || ".join(
        f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    lower = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    parts = [
        f"""h AS (
  SELECT doc_id, source, sha256({fields('text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({fields(lower)}) ELSE sha256({fields('text')}) END AS shown
  FROM documents
),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM h
),
s0 AS (SELECT tree, i, n, leaf AS d FROM leaves),
c0 AS (SELECT r, tree, i, shown AS f, '' AS proof FROM leaves)"""
    ]

    def levels(table: str, climb: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"""{table}{k}r AS (SELECT tree, i // 16 AS up, any_value(n) AS n, list(d ORDER BY i) AS ch FROM {table}{k} GROUP BY ALL),
{table}{k + 1} AS (SELECT tree, up AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ch, '')) ELSE ch[1] END AS d FROM {table}{k}r),
{climb}{k + 1} AS (
  SELECT r, tree, i // 16 AS i, CASE WHEN n > 1 THEN sha256(b || f || e) ELSE f END AS f, CASE WHEN n > 1 THEN proof || b || e ELSE proof END AS proof
  FROM (
    SELECT r, c.tree, i, f, proof, n, array_to_string(ch[1:i % 16], '') AS b, array_to_string(ch[i % 16 + 2:], '') AS e
    FROM {climb}{k} c JOIN {table}{k}r t ON t.tree = c.tree AND t.up = c.i // 16
  )
)"""
            )

    levels("s", "c", heights)
    parts.append(f"u0 AS (SELECT -1 AS tree, tree AS i, count(*) OVER () AS n, d FROM s{heights})")
    parts.append(f"k0 AS (SELECT r, -1 AS tree, tree AS i, f, proof FROM c{heights})")
    levels("u", "k", top_heights)
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT l.doc_id, l.leaf, s.d AS subroot, u.d AS root, sha256(k.proof) AS proof_sha256, k.f AS folded_root, k.f = u.d AS verified
FROM leaves l JOIN s{heights} s ON s.tree = l.tree JOIN k{top_heights} k ON k.r = l.r CROSS JOIN u{top_heights} u
"""
    )


def op12_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_training_order": op7_training_order,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ring_shards": op12_ring_shards,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op1_warc": OP1_SQL,
    "op3_license_scan": _op3_sql(),
    "op5_exact_top_k": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op11_merkle_manifest": _op11_sql(),
}
