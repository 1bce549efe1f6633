"""One query per corpus operator over its whole table, and SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    collocation,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    sentence_dedup,
    sharding,
    simhash,
    spelling,
    spotsigs,
    suffix_dedup,
    toxicity,
    vector_dedup,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_dedup.remove_repeated_sentences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, "doc_id", sharding.shard_names()).select("doc_id", "slot", "shard")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LLM_ORACLE["op9_sharding"] = f"""
    WITH owners AS (SELECT [{", ".join(map(str, sharding.fill(sharding.shard_names())))}] AS o),
         slots AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                                       % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, slot, CAST(o[slot + 1] AS INTEGER) AS shard FROM slots, owners"""

LLM_ORACLE["op3_vector_dedup"] = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
              UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept,
           CAST(1 AS DOUBLE) AS audit_recall
    FROM parts LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) ON a = vec_id"""

LLM_ORACLE["op1_sentence_dedup"] = f"""
    WITH cut AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (
                   SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(1)),
                                               '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l
                   FROM documents)),
    placed AS (SELECT *, greatest(1, sum(CAST(regexp_matches(piece, '\\S') AS INTEGER)) OVER (
                 PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS sid FROM cut),
    s AS (SELECT doc_id, CAST(sid AS BIGINT) AS sid, string_agg(piece, '' ORDER BY pos) AS whole FROM placed
          GROUP BY ALL HAVING regexp_matches(string_agg(piece, ''), '\\S')),
    n AS (SELECT *, trim(regexp_replace(lower(whole), '\\s+', ' ', 'g')) AS norm FROM s),
    w AS (SELECT *, len(string_split(norm, ' ')) AS words,
                 sum(len(string_split(norm, ' '))) OVER (PARTITION BY doc_id ORDER BY sid) AS total FROM n),
    runs AS (SELECT a.doc_id, a.sid AS first, min(b.sid) AS last FROM w a JOIN w b
             ON a.doc_id = b.doc_id AND b.sid >= a.sid + {sentence_dedup.SENTENCES - 1}
                AND b.total - a.total + a.words >= {sentence_dedup.WORDS} GROUP BY ALL),
    lists AS (SELECT doc_id, list(norm ORDER BY sid) AS l FROM w GROUP BY 1),
    again AS (SELECT doc_id, first, last, row_number() OVER (
                PARTITION BY array_to_string(list_slice(l, first, last), chr(10)) ORDER BY doc_id, first) AS r
              FROM runs JOIN lists USING (doc_id)),
    marked AS (SELECT w.doc_id, w.sid, w.whole, count(g.first) > 0 AS gone FROM w LEFT JOIN
                 (SELECT * FROM again WHERE r > 1) g ON w.doc_id = g.doc_id AND w.sid BETWEEN g.first AND g.last
               GROUP BY ALL),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY sid), false) AS start
              FROM marked)
    SELECT d.doc_id, count(sid) AS n_sentences, count(*) FILTER (gone) AS n_removed, count(*) FILTER (start) AS n_spans,
           sha256(CASE WHEN count(*) FILTER (gone) = 0 THEN coalesce(any_value(d.text), '')
                       ELSE coalesce(string_agg(whole, '' ORDER BY sid) FILTER (NOT gone), '') END) AS kept_sha256
    FROM documents d LEFT JOIN edges USING (doc_id) GROUP BY d.doc_id"""

LLM_ORACLE["op13_line_dedup"] = f"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    s AS (SELECT row_id, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
    gone AS (SELECT key FROM k WHERE length(key) >= {line_dedup.MIN_CHARS}
             GROUP BY key HAVING count(DISTINCT row_id) >= {line_dedup.MIN_DOCS})
    SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN gone USING (key) GROUP BY row_id, doc_id"""

LLM_ORACLE["op12_collocations"] = f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM pieces),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
    starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    grams AS (SELECT lang, ws, i, unnest(range(1, {collocation.MOST_WORDS + 1})) AS m FROM starts),
    f AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM grams
          WHERE i + m - 1 <= len(ws) GROUP BY 1, 2),
    c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f
          WHERE f >= {collocation.MIN_COUNT} AND contains(phrase, ' ')),
    cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM c),
    scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
                      CAST((CAST({collocation.SCALE} AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
               FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:k], ' ')
                         JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, a, ws, unnest(range(1, len(ws) + 1)) AS i FROM c WHERE len(ws) > 2),
    spans AS (SELECT lang, a, ws, i, unnest(range(2, len(ws))) AS m FROM longer),
    covers AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM spans
               WHERE i + m - 1 <= len(ws) GROUP BY 1, 2),
    kept AS (SELECT worst.* FROM worst LEFT JOIN covers USING (lang, phrase)
             WHERE longest IS NULL OR 100 * longest < {collocation.COVER} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN n USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {collocation.TOP}"""
