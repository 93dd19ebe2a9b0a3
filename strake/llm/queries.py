"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, jaccard, langid, lm, mixing, quality, secrets, suffix, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(n: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.suffix_dedup(_read(spark, sf_dir, "documents"))
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, sf_dir, "documents"))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), fold(5) != 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, fold(3) != 1)
    return found.select("doc.doc_id", "lang_pred", "score").select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _is(kind: str):
    return lambda x: x == kind


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.ADDED)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("spans.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ppm_score": op3_ppm_score,
    "op4_language_id": op4_language_id,
    "op5_main_text": op5_main_text,
    "op6_quality": op6_quality,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES = {
    "op1_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1098) AS piece, least(500, length(h) // 2 - 49 - o) AS n FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 500)) AS o FROM d)),
        w AS (SELECT doc_id, o + q AS p, substr(piece, 2 * q + 1, 100) AS s FROM (SELECT *, unnest(range(n)) AS q FROM c)),
        m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        g AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.least),
        i AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY p) AS run
              FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS is_new FROM g)),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
        k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS upto FROM r),
        n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id)
    """,
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, list_sort(list(DISTINCT array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY doc_id),
        t AS (SELECT min(doc_id) AS id, count(*) AS n_copies, len(any_value(s)) AS size, any_value(s) AS s, md5(array_to_string(s, chr(10))) AS k FROM g GROUP BY k),
        x AS (SELECT id, size, unnest(s) AS v FROM t),
        p AS (SELECT a.id AS a, b.id AS b, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id),
        e AS (SELECT a, b FROM p WHERE 10 * c >= 8 * (sizes - c)),
        l AS (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e),
        r(id, root) AS (SELECT id, id FROM t UNION SELECT l.other, r.root FROM r JOIN l ON r.id = l.id),
        c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
        n AS (SELECT id, count(*) AS n_links FROM l GROUP BY id),
        o AS (SELECT g.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, t.n_copies FROM g JOIN t ON md5(array_to_string(g.s, chr(10))) = t.k JOIN c ON c.id = t.id LEFT JOIN n ON n.id = t.id)
        SELECT d.doc_id, coalesce(o.class_id, d.doc_id) AS class_id, coalesce(o.n_links, 0) AS n_links, coalesce(o.n_copies, 1) AS n_copies FROM d LEFT JOIN o USING (doc_id)
    """,
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ASC NULLS LAST))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
               FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        ls AS (SELECT DISTINCT l FROM bw),
        dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
        h AS (SELECT doc_id, item_id, i, l FROM dw JOIN bw USING (l, s)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ks, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op10_mix_sources": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(strlen(text), 0)::BIGINT AS bytes,
                          ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS rk FROM d GROUP BY source),
        w AS (SELECT *, ([5, 2, 1])[(rk % 3 + 1)::INT]::HUGEINT AS w, (3 * s)::HUGEINT AS cap FROM s),
        o AS (SELECT *, sum(s) OVER ()::HUGEINT AS t, sum(w) OVER ()::HUGEINT AS ws,
                     coalesce(sum(cap) OVER p, 0)::HUGEINT AS c_before, coalesce(sum(w) OVER p, 0)::HUGEINT AS w_before,
                     row_number() OVER (ORDER BY cap::DOUBLE / w::DOUBLE, rk) AS k
              FROM w WINDOW p AS (ORDER BY cap::DOUBLE / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT min(k) AS k FROM o WHERE (t - c_before) * w <= cap * (ws - w_before)),
        l AS (SELECT (t - c_before)::DOUBLE / (ws - w_before)::DOUBLE AS level, o.k FROM o JOIN f USING (k)),
        g AS (SELECT source, s, CASE WHEN t = 0 THEN 0.0 WHEN o.k < l.k THEN cap::DOUBLE ELSE l.level * w::DOUBLE END AS target FROM o, l),
        f2 AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS r FROM g),
        x AS (SELECT *, length(bin(bytes)) * 32 + (bytes >> greatest(length(bin(bytes)) - 5, 0)) AS cls FROM d),
        c AS (SELECT source, cls, count(*) AS n, sum(size)::DOUBLE AS words, row_number() OVER (PARTITION BY source ORDER BY cls DESC) AS i,
                     ('0x' || substr(md5('17:' || concat_ws(':', coalesce(source, ''), cls::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM x GROUP BY source, cls),
        k(source, i, cls, k, lack, rest) AS (
            SELECT source, 0::BIGINT, NULL::BIGINT, 0::BIGINT, (r - floor(r)) * s::DOUBLE, s::DOUBLE FROM f2
            UNION ALL
            SELECT source, i, cls, k, lack - k::DOUBLE * (words / n::DOUBLE), rest - words
            FROM (SELECT c.source, c.i, c.cls::BIGINT AS cls, c.n, c.words, k.lack, k.rest,
                         least(floor((CASE WHEN rest > 0 THEN least(1.0, greatest(0.0, lack / rest)) ELSE 0.0 END) * c.n::DOUBLE + c.u)::BIGINT, c.n) AS k
                  FROM k JOIN c ON c.source IS NOT DISTINCT FROM k.source AND c.i = k.i + 1)),
        y AS (SELECT *, row_number() OVER (PARTITION BY source, cls ORDER BY coin) AS place FROM x)
        SELECT doc_id, size, f2.s AS source_size, f2.target, size * (floor(r)::BIGINT + CASE WHEN place <= k.k THEN 1 ELSE 0 END) AS taken
        FROM y JOIN k ON y.source IS NOT DISTINCT FROM k.source AND y.cls = k.cls JOIN f2 ON y.source IS NOT DISTINCT FROM f2.source
    """,
}
