"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, convtrie, decontam, divergence, langid, licenses, linededup, mixing, ngramjoin, paradedup, secretscan, tokenstore
from .common import crc_fold, fresh, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: half of the paths first, then all of them, of which only what is new to the ledger is scanned.

    The ledger lies in the shared folder for as long as the run; a job that goes on gives secretscan.Ledger a path of its own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secretscan.Ledger(spark, fresh(spark, "ledger"))
    for versions in (docs.where(crc_fold(F.col("doc_id"), 2) == 0), docs):
        ledger.scan(versions)
    found = secretscan.report(docs, ledger.read())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM benchmark),
dp AS (SELECT doc_id, h, unnest(range(1, len(h) - 6)) AS i FROM d),
bp AS (SELECT item_id, h, unnest(range(1, len(h) - 6)) AS i FROM b),
ds AS (SELECT doc_id, i, 0 AS m, concat_ws(' ', h[i], h[i+1], h[i+2], h[i+4], h[i+5], h[i+7]) AS s FROM dp
       UNION ALL SELECT doc_id, i, 1, concat_ws(' ', h[i], h[i+2], h[i+3], h[i+4], h[i+6], h[i+7]) FROM dp),
bs AS (SELECT item_id, i, 0 AS m, concat_ws(' ', h[i], h[i+1], h[i+2], h[i+4], h[i+5], h[i+7]) AS s FROM bp
       UNION ALL SELECT item_id, i, 1, concat_ws(' ', h[i], h[i+2], h[i+3], h[i+4], h[i+6], h[i+7]) FROM bp),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS diag FROM ds JOIN bs USING (m, s)),
cells AS (SELECT doc_id, item_id, diag, k, CASE WHEN dh[k + diag] = bh[k] THEN 1 ELSE -1 END AS v, len(bh) AS n
          FROM (SELECT hits.*, d.h AS dh, b.h AS bh, unnest(range(greatest(1, 1 - diag), least(len(b.h), len(d.h) - diag) + 1)) AS k
                FROM hits JOIN d USING (doc_id) JOIN b USING (item_id))),
sums AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, diag ORDER BY k) AS p FROM cells),
best AS (SELECT doc_id, item_id, n, p - least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, diag ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM sums)
SELECT doc_id, item_id, CAST(max(score) AS BIGINT) AS score, CAST(max(n) AS BIGINT) AS item_tokens
FROM best GROUP BY doc_id, item_id HAVING max(score) >= least(12, greatest(8, ceil(max(n) * 0.6)))
UNION ALL SELECT DISTINCT doc_id, item_id, CAST(len(b.h) AS BIGINT), CAST(len(b.h) AS BIGINT) FROM d JOIN b ON d.h = b.h WHERE len(b.h) BETWEEN 1 AND 7
"""

OP9_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, i, trim(ln) AS t, length(trim(ln)) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE trim(ln) <> ''),
m AS (SELECT b.doc_id, b.i, b.c, a.doc_id AS of_doc, b.r - a.r AS far, b.r - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.r - a.r ORDER BY b.r) AS run
      FROM f a JOIN f b ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.r < b.r)),
runs AS (SELECT doc_id, of_doc, far, run FROM m GROUP BY ALL HAVING count(*) >= 2 AND sum(c) >= 50 OR sum(c) >= 200),
whole AS (SELECT doc_id, row_number() OVER (PARTITION BY string_agg(t, chr(10) ORDER BY r) ORDER BY doc_id) AS nth FROM f GROUP BY doc_id HAVING NOT (count(*) >= 2 AND sum(c) >= 50 OR sum(c) >= 200)),
g AS (SELECT doc_id, i FROM m JOIN runs USING (doc_id, of_doc, far, run) UNION SELECT f.doc_id, i FROM f JOIN whole USING (doc_id) WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_gone, sha256(coalesce(string_agg(l.ln, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""

OP10_SQL = r"""
WITH m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS o, 12 AS least_len, string_split_regex(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
    regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits, regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS vals
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 'access', 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 'hex', 2, 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
h AS (SELECT doc_id, kind, o, least_len, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS n FROM m),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS e FROM h),
s AS (SELECT doc_id, kind, count(*) AS c, list({'a': e - length(hit), 'o': o, 'x': kind || ':' || CAST(e - length(hit) AS VARCHAR) || ':' || CAST(e AS VARCHAR)}) AS x FROM p WHERE length(val) >= least_len GROUP BY doc_id, kind),
r AS (SELECT doc_id, sum(c) FILTER (WHERE kind = 'assign') AS n_assign, sum(c) FILTER (WHERE kind = 'access') AS n_access, sum(c) FILTER (WHERE kind = 'hex') AS n_hex,
  array_to_string(list_transform(list_sort(flatten(list(x))), lambda y: y.x), ',') AS spans FROM s GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN r USING (doc_id)
"""


#: A crc32 step takes a byte and then eight bits; DuckDB has no function for it.
OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
    lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)) % 6 AS h, max(p) AS own FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, c.own, count(t.p) AS k FROM c LEFT JOIN t ON t.conv_id = c.base AND t.p <= c.h GROUP BY ALL),
w AS (SELECT k.conv_id, t.p AS d, t.r, t.x FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.h
      UNION ALL SELECT k.conv_id, t.p - k.h + k.k, t.r, t.x FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h),
s AS (SELECT k.conv_id, coalesce(list(md5(w.r || chr(1) || w.x) ORDER BY w.d) FILTER (WHERE w.d IS NOT NULL), []) AS ids, coalesce(list(length(w.x) ORDER BY w.d) FILTER (WHERE w.d IS NOT NULL), []) AS ns FROM k LEFT JOIN w USING (conv_id) GROUP BY k.conv_id),
m AS (SELECT conv_id, len(ids) AS l, unnest(range(0, len(ids) + 1)) AS d, ids, ns FROM s),
g AS (SELECT conv_id, l, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(ids[1:d], '') END AS key, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n FROM m),
nodes AS (SELECT key, any_value(d) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends_sha256 FROM g GROUP BY key),
kids AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
up AS (SELECT left(key, 32 * a) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM each) GROUP BY 1)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, up.n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
FROM each e JOIN up USING (key) LEFT JOIN nodes p ON e.depth > 0 AND p.key = left(e.key, 32 * (e.depth - 1))
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT doc, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total FROM lc GROUP BY lang),
lq AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tm AS (SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM cells JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pr
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INT) FROM tm WHERE rank <= 50
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_language_id, op2_paragraph_dedup, op3_token_files, op4_decontamination, op5_bpe, op6_license_scan, op7_nearest, op8_ngram_join, op9_line_dedup, op10_secret_scan, op11_prefix_trie, op12_source_mix, op13_divergence_audit,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op9_line_dedup": OP9_SQL, "op10_secret_scan": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_divergence_audit": OP13_SQL}
