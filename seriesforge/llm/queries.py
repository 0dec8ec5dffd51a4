"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .byte_bpe import decode, encode
from .common import table
from .html_extract import extract_text
from .knn_join import top_inner_products
from .license_scan import scan_licenses
from .near_dedup import near_duplicates
from .packing import pack, token_pieces
from .periodic_runs import longest, periodic_runs
from .pii import BASE, describe, find_pii
from .quality import score_quality
from .spelling_variants import spelling_variants
from .suffix_dedup import suffix_dedup
from .vector_packing import pack_best_fit, whole_pieces


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return out.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is 1 where a whole template stands, 0.5 where only base phrases do, else 0."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.when(F.exists("spans", lambda s: ~s["base"]), 1.0).when(F.size("spans") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)
    return pack(pieces, size=2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(describe(base), 256).alias("base_sha256"), describe(F.col("spans")).alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=7, least_count=2, ratio=10, slips=31)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = whole_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)
    return pack_best_fit(pieces, size=4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents repeat a part of their words: with h = crc32 of the decimal doc_id, those where 10 divides h.

    Their word i becomes, from a = floor(h / 10) % n on, word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + floor(h / 10) % 8)).
    Null ids have no h; such documents stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return some.select("doc_id", F.when(F.coalesce(n, F.lit(0)) > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = periodic_runs(looped(table(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_html_extract, op3_ann, op4_license_scan, op5_byte_bpe, op6_near_dedup, op7_quality, op8_packing, op9_knn_join, op10_pii, op11_spelling_variants, op12_vector_packing, op13_periodic_runs)}
_VECTORS = "SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    eight = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {eight}, 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE_SQL = {
    # all distances, exactly: the search must find the true neighbours here (its recall on larger tables is tested apart)
    "op3_ann": f"""
WITH v AS (SELECT vec_id, e FROM ({_VECTORS}) WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_knn_join": f"""
WITH v AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM ({_VECTORS})),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # every near pair through the strings that lose one code point; the automata and halves find the same ones
    "op11_spelling_variants": f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS w FROM documents),
     counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS k, w, count(*) AS n FROM found GROUP BY ALL),
     hashed AS (SELECT w, n, {_crc32("k")} AS h FROM counted),
     slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
     words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     places AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words),
     less AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS d FROM places),
     near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.d = b.d AND a.p = b.p AND a.word <> b.word
              UNION SELECT less.word, words.word FROM less JOIN words ON d = words.word
              UNION SELECT words.word, less.word FROM less JOIN words ON d = words.word),
     ranked AS (SELECT near.word, other, o.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS r FROM near JOIN words o ON other = o.word),
     formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 10 * w.n THEN other END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
                FROM words w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON w.word = r.word),
     chain AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL
               UNION ALL SELECT chain.word, form FROM chain JOIN formed ON root = formed.word WHERE form IS NOT NULL),
     ends AS (SELECT chain.word, root FROM chain JOIN formed ON root = formed.word WHERE formed.form IS NULL)
SELECT formed.word, form, coalesce(root, formed.word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends ON formed.word = ends.word""",
    # every pair of equal words of a document at a distance of up to a quarter of it, and their islands; the grid finds the same runs
    "op13_periodic_runs": f"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
     turning AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
     turned AS (SELECT doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM turning),
     words AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM turned),
     pairs AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
     islands AS (SELECT doc_id, p, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island, i FROM pairs),
     stretches AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
     runs AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY ALL),
     digests AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
                        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM turned LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
