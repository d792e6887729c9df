"""Named queries of the pipeline operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, divergence, html_text, jaccard_join, language, line_dedup, mixing,
               prefix_trie, quality, secrets, simhash, toxicity, vector_search)
from .stream import small_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(n: int) -> Column:
    """crc32 of the document id's text modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_remainder(4) == 2
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, folder, "labels"), ~held_out)
    return quality.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_remainder(3) == 1
    documents = table(spark, folder, "documents")
    profiles = language.train(documents, ~held_out)
    return language.identify(documents.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex",
        F.sha2(F.col("secrets.base").cast("binary"), 256).alias("base_sha256"),
        "secrets.spans", "secrets.n_cut")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark items it overlaps, and where."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contaminated(documents, table(spark, folder, "benchmark"))
    return (documents.select("doc_id").join(found, "doc_id", "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), "items",
                    F.to_json("spans").alias("spans")))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_remainder(5) == 0
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    index = vector_search.build(table(spark, folder, "embeddings"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return vector_search.top_k(index, F.col("id") % 50 == 0, 5)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what is left of it, as a digest, and the lines it lost."""
    left = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"),
                                  report=True)
    return left.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"),
                       "copy_of", F.coalesce(F.size("lines_lost"), F.lit(0)).alias("n_lost"),
                       F.array_join("lines_lost", ",").alias("lines_lost"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_classes(table(spark, folder, "documents"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.digits(F.col("fp")).alias("fingerprint"), "component_id")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    return prefix_trie.nodes(*prefix_trie.regrown(turns))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_vector_search": op7_vector_search,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_simhash": op11_simhash,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op7_vector_search": """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (
               PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    # Members of a node hold the heads of all nodes below it; a node is below another if it is as
    # deep and its head is a member of it. Prefixes are compared as text, not by digest.
    "op12_prefix_trie": r"""
WITH ids AS (
    SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
family AS (
    SELECT c, c - c % 20 AS base, CAST(xor(list_reduce(
        list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS UBIGINT)),
        lambda r, b: list_reduce(list_transform(range(8), lambda k: CAST(k AS UBIGINT)),
            lambda a, k: xor(a >> 1, (a & 1) * CAST(3988292384 AS UBIGINT)), xor(r, b)),
        CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h
    FROM ids),
turns AS (
    SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
chosen AS (
    SELECT f.c, t.pos, t.role, t.text, 0 AS own FROM family f JOIN turns t ON t.c = f.base
    WHERE t.pos <= f.h
    UNION ALL
    SELECT f.c, t.pos, t.role, t.text, 1 FROM family f JOIN turns t ON t.c = f.c WHERE t.pos > f.h),
placed AS (
    SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth FROM chosen),
member AS (
    SELECT c, depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '' )
               OVER (PARTITION BY c ORDER BY depth) AS prefix, text AS last FROM placed
    UNION ALL SELECT c, 0, '', '' FROM ids),
long AS (SELECT c, max(depth) AS length FROM member GROUP BY c),
above AS (
    SELECT m.c, m.depth, m.prefix, m.last, p.prefix AS parent, l.length FROM member m
    JOIN long l ON l.c = m.c LEFT JOIN member p ON p.c = m.c AND p.depth = m.depth - 1),
node AS (
    SELECT depth, prefix, min(parent) AS parent, min(c) AS head, count(*) AS n_convs,
           (count(*) - 1) * len(regexp_extract_all(min(last), '[^\x20\x09-\x0D]+')) AS saved,
           max(length) = depth AS childless,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)
                           FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM above GROUP BY depth, prefix),
below AS (
    SELECT m.depth, m.prefix, sum(v.saved) AS saved_tokens,
           count(*) FILTER (WHERE v.childless) AS n_leaves
    FROM member m JOIN node v ON v.head = m.c AND v.depth >= m.depth GROUP BY m.depth, m.prefix),
kids AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n FROM node WHERE depth > 0
         GROUP BY 1, 2)
SELECT n.head AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.head AS parent_conv_id,
       n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = n.parent
LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix
""",
    "op13_divergence": r"""
WITH filled AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(text, '') AS text
    FROM documents),
word AS (
    SELECT id, lang, source, translate(unnest(regexp_extract_all(
               text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM filled),
kept AS (
    SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
volume AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM filled),
counted AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM word w
    JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
cell AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
    SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * CAST(c.n + 1 AS HUGEINT))
           // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + v.v) AS p
    FROM cell c JOIN volume v ON v.lang = c.lang),
whole AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term),
q AS (
    SELECT w.lang, w.term, 1 + (1000000000 * CAST(w.n + 1 AS HUGEINT))
           // (sum(w.n) OVER (PARTITION BY w.lang) + v.v) AS q
    FROM whole w JOIN volume v ON v.lang = w.lang),
pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
    GROUP BY 1, 2, 3),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT)
    FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
    SELECT *, CAST(row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
