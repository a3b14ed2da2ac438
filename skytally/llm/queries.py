"""The registered queries of this package: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import ann, bpe, fingerprints, hard_negatives, langid, licences, lm, near_dup, packing, phrases, quality, sharding, token_files
from skytally.llm.common import scratch_path, table
from skytally.llm.tokens import read_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def vocabulary_file(name: str) -> str:
    """Text of one of the installed public tokenizer files."""
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("op1_token_files")
def op1_token_files(spark, folder):
    path = scratch_path(spark, "tokens")
    out = token_files.token_files(documents(spark, folder), path, vocabulary_file("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_sharding")
def op2_sharding(spark, folder):
    out = sharding.shard(documents(spark, folder), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                      "virtual_slot", "map_version")


@query("op3_bpe")
def op3_bpe(spark, folder):
    return bpe.encode_decode(documents(spark, folder), vocabulary_file("byte_bpe_50k.json"))


@query("op4_packing")
def op4_packing(spark, folder):
    return packing.pack(documents(spark, folder), vocabulary_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query("op5_quality")
def op5_quality(spark, folder):
    out = quality.classify(documents(spark, folder), table(spark, folder, "labels"))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "entropy", "lowest", "highest", "accepted")


@query("op6_ann")
def op6_ann(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"), every=20, k=20)


@query("op7_lm")
def op7_lm(spark, folder):
    return lm.score(documents(spark, folder))


@query("op8_near_dup")
def op8_near_dup(spark, folder):
    return near_dup.near_duplicates(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_fingerprints")
def op9_fingerprints(spark, folder):
    return fingerprints.fingerprints(documents(spark, folder))


@query("op10_langid")
def op10_langid(spark, folder):
    return langid.identify(documents(spark, folder))


@query("op11_phrases", """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
words AS (SELECT lang, [w FOR w IN string_split_regex(piece, '[\\x20\\x09]+') IF w <> ''] AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT lang, ws[i:i + k - 1] AS g FROM starts, range(1, 5) AS lengths(k) WHERE i + k - 1 <= len(ws)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS BIGINT) AS score
    FROM candidates c JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[c.k + 1:len(c.g)]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
    SELECT lang, g[s:s + m - 1] AS g, max(a) AS longer FROM lowest, range(2, 4) AS lengths(m), range(1, 4) AS places(s)
    WHERE m < len(g) AND s + m - 1 <= len(g) GROUP BY ALL
)
SELECT lang, row_number() OVER w AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM lowest LEFT JOIN inside USING (lang, g) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))
QUALIFY row_number() OVER w <= 2000
""")
def op11_phrases(spark, folder):
    return phrases.phrases(documents(spark, folder))


@query("op12_hard_negatives", """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT) FOR c IN embedding] AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
        CAST(list_sum([a.x[i] * b.x[i] FOR i IN range(1, len(a.x) + 1)]) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
""")
def op12_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), label=label)


@query("op13_licences")
def op13_licences(spark, folder):
    return licences.labelled(licences.scan(documents(spark, folder)))
