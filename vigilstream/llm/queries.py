"""The operators as registered queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigilstream.llm import bpe_codec, decontamination, language_id, line_dedup, lm_score, neighbours, ngram_join, quality, secret_scan, substring_dedup, token_counts, treap_search, turn_repair
from vigilstream.llm.shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir), 13).drop("longest")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir), 3, 90).drop("class_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(_documents(spark, sf_dir)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_documents(spark, sf_dir))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0", 20)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_documents(spark, sf_dir), files=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Query]:
    found = {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_ngram_join": op3_ngram_join,
        "op4_line_dedup": op4_line_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_bpe_codec": op6_bpe_codec,
        "op7_language_id": op7_language_id,
        "op8_nearest": op8_nearest,
        "op9_lm_score": op9_lm_score,
        "op10_decontamination": op10_decontamination,
        "op11_ranked_search": op11_ranked_search,
        "op12_quality": op12_quality,
        "op13_turn_repair": op13_turn_repair,
    }
    return {name: _shipped(query) for name, query in found.items()}


_OP8 = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


_OP1 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
g AS (
  SELECT DISTINCT doc_id, i + j AS pos
  FROM (SELECT k.doc_id, k.i FROM k JOIN f ON k.k = f.k WHERE m < doc_id) CROSS JOIN range(0, 13) t(j)
), w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
s AS (
  SELECT w.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY w.pos), '') AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
_OP4 = """
WITH t AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM t),
b AS (
  SELECT trim(line, chr(32) || chr(9) || chr(13)) AS k FROM l
  WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(k) AS n_removed,
         coalesce(string_agg(CASE WHEN k IS NULL THEN line END, chr(10) ORDER BY pos), '') AS kept
  FROM l LEFT JOIN b ON trim(line, chr(32) || chr(9) || chr(13)) = k GROUP BY 1
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM d
), k AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s), often AS (SELECT k FROM k GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT doc_id, n, k FROM k WHERE k IN (FROM often)),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1), l AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.root, s.doc_id)) AS component_id, coalesce(l.n, 0) AS n_links
FROM s LEFT JOIN c ON c.doc_id = s.doc_id LEFT JOIN l ON l.doc_id = s.doc_id
"""


_VALUE = {"assign": ("length(v) >= 8", 2), "access": ("length(v) >= 16", 0), "hex": ("length(v) >= 32", 0), "owned": ("regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')", 0)}


def _kind_sql(at: int, name: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    good, group = _VALUE[name]
    return f"""SELECT doc_id, source, text, {at} AS kind, v, stop - length(w) AS start, stop FROM (
  SELECT *, sum(length(p) + length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM (
    SELECT doc_id, source, text, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v, unnest(whole) AS w, unnest(string_split_regex(text, '{pattern}')[:len(whole)]) AS p, generate_subscripts(whole, 1) AS i
    FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS whole FROM d))) WHERE {good}"""


def _op5() -> str:
    kinds = [*((name, pattern) for name, pattern, *_ in secret_scan.BASE), ("owned", secret_scan.TOKEN)]
    found = "\nUNION ALL ".join(_kind_sql(k, *x) for k, x in enumerate(kinds))
    joined = "string_agg(concat(['assign', 'access', 'hex', 'owned'][kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind, stop)"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents), m AS ({found}),
s AS (SELECT * FROM m WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.kind < 3 AND b.start < m.stop AND m.start < b.stop)),
who AS (SELECT DISTINCT v, string_split(source, '/')[1] AS owner, source FROM (SELECT v, text, arg_min(source, [string_split(source, '/')[1], source]) AS source FROM s GROUP BY v, text)),
l AS (SELECT v, count(DISTINCT owner) <= 1 AND count(*) <= 10 AS live FROM who GROUP BY v),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {joined} FILTER (kind < 3) AS base,
  {joined} FILTER (kind < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM s JOIN l USING (v) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


_OP10 = r"""
WITH b AS (
  SELECT item_id, w, CAST(len(w) AS BIGINT) AS n, CAST(least(len(w), 5) AS BIGINT) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0
), g AS (SELECT item_id, n, k, n - k + 1 AS m, h, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM b)) GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS size, k, i, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
s AS (SELECT doc_id, size, item_id, n, g.k, m, i, t.h, c FROM t JOIN g ON t.k = g.k AND t.h = g.h),
e AS (SELECT doc_id, item_id, size, n, k, m FROM s GROUP BY ALL HAVING count(*) >= greatest(1, ceil(2 * m * 0.8 / 1.8 - 1e-6))),
p AS (SELECT *, unnest(range(1, greatest(size - n + 1, 1) + 1)) AS start FROM e),
o AS (SELECT p.doc_id, p.item_id, p.start, p.m, least(p.n, p.size) - p.k + 1 AS own, s.h, least(count(*), any_value(c)) AS c
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.item_id = p.item_id AND s.i BETWEEN p.start AND p.start + p.m - 1 GROUP BY ALL),
v AS (SELECT doc_id, item_id, start, CAST(sum(c) AS DOUBLE) / (any_value(own) + any_value(m) - sum(c)) AS similarity FROM o GROUP BY 1, 2, 3),
f AS (SELECT doc_id, item_id, max(similarity) AS similarity FROM v WHERE similarity >= 0.8 GROUP BY 1, 2),
a AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids, max(similarity) AS similarity FROM f GROUP BY 1)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(ids, '') AS item_ids, coalesce(similarity, 0.0::DOUBLE) AS similarity FROM d LEFT JOIN a ON a.doc_id = d.doc_id
""".replace("\\\\", "\\")


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT k, item_id, term, count(*) AS times FROM (
    SELECT k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS k, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))) GROUP BY ALL
), n AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
t AS (
  SELECT k, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM t WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
_OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc
), r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r
), f AS (
  SELECT conv_id, turn, role, text, i, CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND NOT (ini = 2 AND coalesce(b, 0) IN (1, 3) OR ini = 3 AND b = 2)) AS illegal, max(i) AS n
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM f) GROUP BY 1
), go AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS c FROM g
  UNION ALL
  SELECT conv_id, i, [least(e[1], 2 + e[3], 4 + e[4]), least(e[2], 2 + e[3], 4 + e[4]), least(e[3], 2 + e[4], 4 + e[3]), least(e[4], 2 + e[3], 4 + e[4])] FROM (
    SELECT f.conv_id, f.i, CASE WHEN fault IN (1, 2) THEN list_transform(c, lambda x: x + 3) ELSE [
      least(3 + c[1], 2 + k + c[3], CASE ini WHEN 1 THEN k + c[2] WHEN 2 THEN k + c[3] ELSE 1e15::BIGINT END),
      least(3 + c[2], 2 + k + c[3], CASE ini WHEN 2 THEN k + c[3] ELSE 1e15::BIGINT END),
      least(3 + c[3], 2 + k + c[4], CASE ini WHEN 3 THEN k + c[4] ELSE 1e15::BIGINT END),
      least(3 + c[4], 2 + k + c[3], CASE ini WHEN 2 THEN k + c[3] ELSE 1e15::BIGINT END)] END AS e
    FROM go JOIN (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS k FROM f) f ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.i = go.i - 1)
), w AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS said, n FROM g
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kq ELSE xq END, audit || e,
    CASE e WHEN 'D' THEN said WHEN 'I' THEN list_append(said, name || ':') WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, name || ':' || text) END, n
  FROM (
    SELECT w.*, f.role, f.text, x.xq, x.name, kq, CASE
      WHEN w.i > w.n THEN 'I' WHEN 3 + l.c[q] = h.c[q] THEN 'D' WHEN fault IN (1, 2) THEN NULL WHEN 2 + h.c[x.xq] = h.c[q] THEN 'I'
      WHEN kq > 0 AND (CASE WHEN fault = 3 THEN 1 ELSE 0 END) + l.c[kq] = h.c[q] THEN 'K' ELSE 'R' END AS e
    FROM w JOIN go h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
    JOIN (VALUES (1, 3, 'user'), (2, 3, 'user'), (3, 4, 'assistant'), (4, 3, 'user')) x(s, xq, name) ON x.s = w.q
    LEFT JOIN (SELECT f.*, s, CASE WHEN ini = 1 AND s = 1 THEN 2 WHEN ini = 2 AND s <> 3 THEN 3 WHEN ini = 3 AND s = 3 THEN 4 ELSE 0 END AS kq FROM f, range(1, 5) t(s)) f
      ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND f.s = w.q
    LEFT JOIN go l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
    WHERE w.i <= w.n OR w.q IN (2, 3))
), z AS (SELECT w.*, c[1] AS cost FROM w JOIN go ON go.conv_id IS NOT DISTINCT FROM w.conv_id AND go.i = 1 WHERE w.i > w.n AND w.q IN (1, 4)),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op3_ngram_join": _OP3, "op4_line_dedup": _OP4, "op5_secret_scan": _op5(), "op8_nearest": _OP8, "op10_decontamination": _OP10, "op11_ranked_search": _OP11, "op13_turn_repair": _OP13}
