"""The dealt operators as queries over whole tables."""

from __future__ import annotations

from sigwatch.llm import (ann, bpe, chunks, collocations, credentials, filter_audit, packing, sharding, simhash,
                          token_counts, toxicity, warc)
from sigwatch.llm.common import table
from sigwatch.llm.exact import exact_groups
from sigwatch.llm.registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES"]


@query("op7_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n
           FROM documents),
 g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
FROM t JOIN g USING (n)""")
def op7_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_sharding", f"""
WITH f AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
                  CAST(COALESCE(strlen(text), 0) AS BIGINT) AS b FROM documents),
 l AS (SELECT d, h >> (60 - d) AS p, sum(b)::BIGINT AS sb, count(*) AS n
       FROM f, range(0, 61) t(d) GROUP BY ALL HAVING sum(b) <= {sharding.LIMIT} OR count(*) = 1),
 c AS (SELECT f.doc_id, min(l.d) AS d FROM f JOIN l ON l.p = f.h >> (60 - l.d) GROUP BY ALL)
SELECT f.doc_id, f.b AS bytes, CASE WHEN c.d = 0 THEN '' ELSE lpad(bin(l.p), c.d::INT, '0') END AS shard,
 c.d AS depth, l.sb AS shard_bytes, l.n AS shard_rows
FROM f JOIN c USING (doc_id) JOIN l ON l.d = c.d AND l.p = f.h >> (60 - c.d)""")
def op9_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + ((CAST('0x' || substr(sha1(p), 1 + 5 * (i // 4)::INT, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT,
 1)), 'string_agg', '')"""


@query("op10_warc", f"""
WITH t AS (SELECT page_id, COALESCE(html, '') AS p FROM pages),
 g AS (SELECT p, max(page_id) AS response FROM t GROUP BY p)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> response THEN response END AS refers_to
FROM t JOIN g USING (p)""")
def op10_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_secrets")
def op5_secrets(spark, sf_dir):
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return chunks.repeated_spans(table(spark, sf_dir, "documents")).drop("repeats")


@query("op1_graph_ann")
def op1_graph_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_token_counts")
def op11_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op12_filter_audit", r"""
WITH words AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t,
                      list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
               FROM documents),
 judged AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) AS a,
                   CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) AS b,
                   CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) AS c,
                   CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
                   CAST(COALESCE(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS e FROM words),
 marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
           FROM labels GROUP BY doc_id),
 masks AS (SELECT part, a, b, c, d, e, count(*) AS n, COALESCE(sum(good), 0) AS good, COALESCE(sum(toxic), 0) AS toxic
           FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 orders AS (SELECT v.f || w.f || x.f || y.f || z.f AS o
            FROM letters v, letters w, letters x, letters y, letters z
            WHERE length(regexp_replace(v.f || w.f || x.f || y.f || z.f, 'A', '')) = 4
              AND contains(v.f || w.f || x.f || y.f || z.f, 'B') AND contains(v.f || w.f || x.f || y.f || z.f, 'C')
              AND contains(v.f || w.f || x.f || y.f || z.f, 'D') AND contains(v.f || w.f || x.f || y.f || z.f, 'E')),
 failed AS (SELECT *, CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END
            || CASE WHEN c = 1 THEN 'C' ELSE '' END || CASE WHEN d = 1 THEN 'D' ELSE '' END
            || CASE WHEN e = 1 THEN 'E' ELSE '' END AS fails FROM masks),
 placed AS (SELECT part, o, s AS step, n, good, toxic, substr(o, s::INT, 1) AS f, fails,
                   contains(fails, substr(o, s::INT, 1)) AS here,
                   length(translate(substr(o, 1, s::INT - 1), fails, '')) < s - 1 AS earlier
            FROM failed, orders, range(1, 6) t(s)),
 report AS (SELECT part, o, step, f, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
            FROM placed GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
 redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
 toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM report""")
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_collocations", r"""
WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
 f AS (SELECT lang, s, phrase, count(*) AS f
       FROM (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2),
                                                   lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
             FROM words, range(1, 4) t(s)) GROUP BY ALL),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND f >= 10),
 sides AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
           FROM c, range(1, 3) t(k) WHERE k < s),
 cuts AS (SELECT t.lang, t.phrase, a, k, x.f AS l, y.f AS r,
                 (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
          FROM sides t JOIN f x ON x.lang = t.lang AND x.phrase = t.lp JOIN f y ON y.lang = t.lang AND y.phrase = t.rp),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 longer AS (SELECT lang, part, max(f) AS f
            FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
                  FROM c WHERE s = 3) GROUP BY ALL),
 n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank,
 phrase, a, l, r, n, score::BIGINT AS score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase
WHERE g.f IS NULL OR 100 * g.f < 50 * a QUALIFY rank <= 2000""")
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
