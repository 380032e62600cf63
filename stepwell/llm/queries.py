"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import (
    ann,
    annulus,
    decontaminate,
    jaccard_join,
    line_dedup,
    secrets,
    sentencepieces,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
)
from stepwell.llm.common import read


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    said = lambda x: F.concat_ws(":", x.kind, x.start, x.end)
    base = F.filter("spans", lambda x: x.kind.isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.drop("uid")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hits = hits.withColumn("n_hit", decontaminate.covered(F.col("spans")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), "n_rows")).alias("_row"),
    ).drop("_row")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode_decode(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.clusters(read(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_line_dedup,
        op3_secret_scan,
        op4_toxicity,
        op5_decontaminate,
        op6_token_counts,
        op7_simhash_near_dedup,
        op8_substring_dedup,
        op9_sentencepiece,
        op10_nearest,
        op11_jaccard_join,
        op12_annulus_clusters,
        op13_spelling_variants,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM d),
ink AS (SELECT doc_id, line, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos
        FROM l WHERE regexp_matches(line, '[^ \t\r\x0B\x0C]')),
win AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
        FROM ink WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n
           FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest(range(3)) AS k) WHERE n > 1),
marked AS (SELECT l.doc_id, l.line, l.ln, g.pos IS NOT NULL AS out
           FROM l LEFT JOIN ink USING (doc_id, ln) LEFT JOIN gone g ON g.doc_id = ink.doc_id AND g.pos = ink.pos)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (out) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_decontaminate": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1:i + m], ' ') AS g
          FROM (SELECT item_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM bw)),
ms AS (SELECT DISTINCT m FROM grams),
dw AS (SELECT doc_id, i, m, array_to_string(w[i + 1:i + m], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM low, ms WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN grams USING (m, g)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
          FROM (SELECT doc_id, i, unnest(range(m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(50)) AS k
         FROM win JOIN first USING (s) WHERE doc_id > least)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
per AS (SELECT doc_id, CAST(count(g.i) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS kept
        FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)""",
}
