"""The registered queries op1 to op13: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dealt
from . import codec, jaccard, licenses, line_dedup, lm, media, merkle, minhash, packing, spelling, topk, toxicity, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_evidence(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    digit = "(strpos('0123456789ABCDEF', substr(hex(encode({t})), {at}, 1)) - 1)"
    byte = f"({digit.format(t=text, at='2 * i - 1')} * 16 + {digit.format(t=text, at='2 * i')})"
    bits = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: ({byte} >> k::INT) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_minhash_dedup": f"""
            WITH RECURSIVE w AS (
              SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
            ), s AS (
              SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
            ), e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
            often AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
            meet AS (
              SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS c
              FROM (SELECT * FROM e SEMI JOIN often USING (x)) a JOIN (SELECT * FROM e SEMI JOIN often USING (x)) b ON a.x = b.x AND a.r < b.r GROUP BY ALL
            ), links AS (SELECT a, b FROM meet WHERE 100 * c >= 80 * (na + nb - c)),
            reach AS (
              SELECT r AS a, r AS b FROM s
              UNION
              SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.b
            ), least AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a)
            SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (r)
        """,
        "op12_merkle_manifest": f"""
            WITH RECURSIVE d AS (
              SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf_sql("text")} AS leaf,
                CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed FROM documents
            ), l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
            lv AS (
              SELECT g, 0 AS d, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l
              UNION ALL
              SELECT g, d + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), count(*) OVER (PARTITION BY g) FROM lv WHERE n > 1 GROUP BY g, d, pos // 3
            ), sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE n = 1),
            up AS (
              SELECT 0 AS d, pos, subroot AS h, count(*) OVER () AS n FROM sub
              UNION ALL
              SELECT d + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), count(*) OVER () FROM up WHERE n > 1 GROUP BY d, pos // 3
            ), nodes AS (
              SELECT l.g, l.pos, 0 AS part, lv.d, lv.pos AS place, lv.h, l.pos // (3 ** lv.d)::BIGINT AS own FROM l JOIN lv ON lv.g = l.g AND lv.pos // 3 = l.pos // (3 ** (lv.d + 1))::BIGINT WHERE lv.n > 1
              UNION ALL
              SELECT l.g, l.pos, 1, up.d, up.pos, up.h, sub.pos // (3 ** up.d)::BIGINT FROM l JOIN sub ON sub.g = l.g JOIN up ON up.pos // 3 = sub.pos // (3 ** (up.d + 1))::BIGINT WHERE up.n > 1
            ), steps AS (
              SELECT g, pos, row_number() OVER (PARTITION BY g, pos ORDER BY part, d) AS k, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < own), '') AS b,
                coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > own), '') AS a FROM nodes GROUP BY g, pos, part, d
            ), proofs AS (SELECT g, pos, sha256(string_agg(b || a, '' ORDER BY k)) AS p FROM steps GROUP BY g, pos),
            f AS (
              SELECT g, pos, 1 AS k, changed AS h FROM l
              UNION ALL
              SELECT f.g, f.pos, f.k + 1, sha256(b || h || a) FROM f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.k = f.k
            ), last AS (SELECT g, pos, arg_max(h, k) AS h FROM f GROUP BY g, pos)
            SELECT l.doc_id, l.leaf, sub.subroot, up.h AS root, coalesce(p, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = up.h AS verified
            FROM l JOIN sub USING (g) JOIN last ON last.g = l.g AND last.pos = l.pos LEFT JOIN proofs ON proofs.g = l.g AND proofs.pos = l.pos CROSS JOIN (SELECT h FROM up WHERE n = 1) up
        """,
        "op13_spelling_variants": f"""
            WITH RECURSIVE t AS (
              SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
            ), r AS (SELECT doc_id, {_LOWER.format("run")} AS run, count(*) AS k FROM t GROUP BY ALL),
            c AS (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM r),
            h AS (SELECT run, k, {_crc32_sql("named")} AS h FROM c),
            w AS (
              SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
              FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
            ), cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
            near AS (
              SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.less = b.word
              UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.less = b.word
            ), best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
            named AS (SELECT word, best.n_near, best.m, min(near) AS near FROM best JOIN near USING (word, m) GROUP BY ALL),
            f AS (
              SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN named USING (word)
            ), way AS (
              SELECT word, word AS root, 0 AS k FROM f
              UNION ALL
              SELECT way.word, f.form, way.k + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL
            ), last AS (SELECT word, arg_max(root, k) AS root FROM way GROUP BY word)
            SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
        """,
        # every n-gram of a scored document is seen at least once, so its longest context decides
        "op3_lm_score": """
            WITH w AS (
              SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents
            ), t AS (
              SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
              FROM w, unnest(range(1, len(w) + 1)) AS u(i)
            ), n1 AS (SELECT c, count(*) AS n FROM t GROUP BY c),
            n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
            n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
            s AS (
              SELECT t.doc_id, CASE
                WHEN n3.n >= 1 THEN ln(n3.n / x2.n)
                WHEN n2.n >= 1 THEN ln(n2.n / x1.n)
                ELSE ln(n1.n / (SELECT count(*) FROM t)) END AS s
              FROM t JOIN n1 ON n1.c = t.c LEFT JOIN n2 ON n2.b = t.b AND n2.c = t.c LEFT JOIN n3 ON n3.a = t.a AND n3.b = t.b AND n3.c = t.c
              LEFT JOIN n2 x2 ON x2.b = t.a AND x2.c = t.b LEFT JOIN n1 x1 ON x1.c = t.b
            ), d AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
            SELECT w.doc_id, len(w.w)::BIGINT AS n_tokens, round(coalesce(d.s, 0), 4) AS log_score, round(d.s / nullif(len(w.w), 0), 6) AS mean_log_score
            FROM w LEFT JOIN d USING (doc_id)
        """,
        "op4_exact_top_k": """
            WITH v AS (
              SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
              SELECT a.row_id, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.row_id <> b.row_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
            )
            SELECT query_id, (row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
            FROM s QUALIFY rank <= 20
        """,
        "op7_warc": """
            WITH p AS (
              SELECT page_id, url, coalesce(html, '') AS html FROM pages
            ), w AS (
              SELECT *, max(page_id) OVER (PARTITION BY html) AS newest, sha1(html) AS h FROM p
            ), bits AS (
              SELECT *, list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (CAST('0x' || substr(h, (5 * k // 4 + 1)::INT, 1) AS INT) * 16
                 + coalesce(TRY_CAST('0x' || nullif(substr(h, (5 * k // 4 + 2)::INT, 1), '') AS INT), 0))
                // (CASE 5 * k % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)::INT % 32 + 1, 1)) AS letters FROM w
            )
            SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
                   CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> newest THEN newest END AS refers_to
            FROM bits
        """,
        "op6_line_dedup": """
            WITH l AS (
              SELECT doc_id, source, trim(line, ' ') AS line
              FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
            ), bad AS (
              SELECT line, min(doc_id) AS first_doc FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8
            ), d AS (
              SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
                     unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
            )
            SELECT d.doc_id, count(*) AS n_lines,
                   count(*) FILTER (WHERE first_doc <> d.doc_id) AS n_removed,
                   coalesce(length(string_agg(d.line, chr(10) ORDER BY i) FILTER (WHERE first_doc IS NULL OR first_doc = d.doc_id)), 0) AS kept_chars,
                   md5(coalesce(string_agg(d.line, chr(10) ORDER BY i) FILTER (WHERE first_doc IS NULL OR first_doc = d.doc_id), '')) AS kept_md5
            FROM d LEFT JOIN bad ON bad.line = trim(d.line, ' ')
            GROUP BY d.doc_id
        """,
    }
