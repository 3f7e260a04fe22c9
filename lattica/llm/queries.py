"""The queries of the training-data operators, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from lattica.llm import bpe, fill_middle, fingerprint, jaccard_join, mixing, personal_data, piece_count, quality, suffix_dedup, tandem_runs, top_k, url_filter, warc
from lattica.llm.util import scratch


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op9.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"), min_len=100)


def op3_top_k(spark, sf_dir):
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that cuts texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), *vocabulary())


#: Target weights of the mix by level; sources weigh alike within a language of a domain.
MIX_WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {})


def mix_levels():
    """Domain (by the source's MD5: the table has no domains of its own), language, source."""
    digit = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 4), 16, 10).cast("long") % 4
    return F.concat(F.lit("d"), F.coalesce(digit, F.lit(0)).cast("string")), F.col("lang"), F.col("source")


def op5_mixing(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"), *mix_levels(), MIX_WEIGHTS, fraction=(1, 2), epochs=2)
    return m.select("doc_id", F.col("_mix_domain").alias("domain"), "lang", "source", F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_copies").alias("copies"))


def op6_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write(warc.captures(table(spark, sf_dir, "pages"), min_payload=0), path)
    return warc.page_report(spark, path)


def op7_token_counts(spark, sf_dir):
    return piece_count.count_pieces(table(spark, sf_dir, "documents"), *vocabulary())


def op8_fingerprint(spark, sf_dir):
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.component_report(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_fill_middle(spark, sf_dir):
    return fill_middle.report(table(spark, sf_dir, "documents"), fill_middle.Transform(seed=7, rate=100, spm=50))


def repeated_tail(doc_id: bytes, words: list[bytes]) -> list[bytes]:
    """Of every tenth id (by crc32) the words from a place on repeat a piece of them; a null id counts as no digits."""
    h, n = zlib.crc32(doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_tandem_runs(spark, sf_dir):
    return tandem_runs.report(table(spark, sf_dir, "documents"), least=24, exponent=3, edit=repeated_tail)


def op13_personal_data(spark, sf_dir):
    return personal_data.report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT s, min(ROW(doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE ROW(doc_id, i) <> first),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
p AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS kept FROM r JOIN d USING (doc_id)),
k AS (SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

def _dealt_sql(name: str, rows: str, family: str, budget: str, weight: str, holds: str, order: str) -> str:
    """Water filling of each family's budget in whole numbers, as CTEs ending in ``name`` (all columns of ``rows`` and share)."""
    by = f"PARTITION BY {family} " if family else ""
    return f"""{name}_a AS (SELECT *, CAST({budget} AS BIGINT) AS b,
  CAST(coalesce(sum({holds}) OVER ({by}ORDER BY CAST({holds} AS DOUBLE) / {weight}, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_,
  CAST(sum({weight}) OVER ({by}ORDER BY CAST({holds} AS DOUBLE) / {weight}, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_ FROM {rows}),
{name}_b AS (SELECT *, {holds} * left_ <= {weight} * (b - before_) AS full_ FROM {name}_a),
{name}_c AS (SELECT *, CAST(coalesce(sum(CASE WHEN full_ THEN {holds} END) OVER ({by}), 0) AS BIGINT) AS taken_, CAST(coalesce(sum(CASE WHEN NOT full_ THEN {weight} END) OVER ({by}), 1) AS BIGINT) AS rest_ FROM {name}_b),
{name} AS (SELECT * EXCLUDE (b, before_, left_, full_, taken_, rest_), CASE WHEN full_ THEN {holds} ELSE ({weight} * (b - taken_)) // rest_ END AS share FROM {name}_c)"""


OP5_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, 'd' || coalesce(CAST('0x' || substr(md5(source), 1, 4) AS INTEGER) % 4, 0) AS domain, CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS holds,
  CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1 ELSE 1 END AS w1, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2, 1 AS w3 FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
top0 AS (SELECT domain, max(w1) AS w, CAST(sum(holds) AS BIGINT) AS h FROM leaf GROUP BY 1),
{_dealt_sql("top", "top0", "", "(SELECT sum(n_tokens) FROM t) // 2", "w", "h", "domain NULLS FIRST")},
mid0 AS (SELECT leaf.domain, lang, max(w2) AS w, CAST(sum(holds) AS BIGINT) AS h, max(share) AS db FROM leaf JOIN top USING (domain) GROUP BY ALL),
{_dealt_sql("mid", "mid0", "domain", "db", "w", "h", "lang NULLS FIRST")},
low0 AS (SELECT leaf.*, mid.share AS gb FROM leaf JOIN mid ON leaf.domain = mid.domain AND leaf.lang IS NOT DISTINCT FROM mid.lang),
{_dealt_sql("low", "low0", "domain, lang", "gb", "w3", "holds", "source NULLS FIRST")},
k AS (SELECT t.*, share // tokens AS whole, share % tokens AS part, md5('17:' || (share // tokens) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
      FROM t JOIN low ON t.domain = low.domain AND t.lang IS NOT DISTINCT FROM low.lang AND t.source IS NOT DISTINCT FROM low.source),
r AS (SELECT *, CAST(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) <= part THEN 1 ELSE 0 END AS INTEGER) AS copies FROM k)
SELECT doc_id, domain, lang, source, n_tokens, copies FROM r WHERE copies > 0
"""

OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, n, h, [CAST('0x' || substr(h, 5 * k + 1, 5) AS INTEGER) FOR k IN range(8)] AS g FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((g[1 + i // 4] >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest FROM b),
w AS (SELECT *, max(page_id) OVER (PARTITION BY n, payload_digest) AS winner FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w
"""

OP9_SQL = """
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, verdict)),
m AS (SELECT v.page_id, v.host, v.path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY v.page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM v LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(len(ws) - 3), lambda i: array_to_string(list_slice(ws, i + 1, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY 1) m USING (doc_id)
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS g FROM d),
c AS (SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 AS plain, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b FROM h),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z FROM c),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM s)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_top_k": op3_top_k,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprint": op8_fingerprint,
    "op9_url_filter": op9_url_filter,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_fill_middle": op11_fill_middle,
    "op12_tandem_runs": op12_tandem_runs,
    "op13_personal_data": op13_personal_data,
    "pipeline": pipeline,
}

ORACLES = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_top_k": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
}
