"""The operators of this folder as queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontaminate, html_text, packing, quality, simhash, suffixes, token_files, toxicity, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch_path(spark, "token-files")
    manifest = token_files.write_token_files(common.table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest, out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(common.table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(common.table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_suffix_dedup, op3_simhash, op4_toxicity, op5_html_text, op6_warc, op7_chat, op8_decontamination, op9_quality, op10_packing)}

#: Maximal conversations by comparing the turns themselves.
_OP7 = """
WITH convs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id),
starts AS (SELECT conv_id, turns, turns[1] AS head FROM convs),
gone AS (
  SELECT DISTINCT a.conv_id FROM starts a JOIN starts b
    ON a.head = b.head AND a.conv_id <> b.conv_id AND list_slice(b.turns, 1, len(a.turns)) = a.turns
   AND (len(b.turns) > len(a.turns) OR b.conv_id < a.conv_id))
SELECT conv_id, len(turns) AS n_turns,
       array_to_string(list_transform(turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10)), '') || '<|end|>' || chr(10) AS text
FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM gone)
"""

_OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS win, len(w[i:i+9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN wins USING (win)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_RULES = ", ".join(f"('{r}', CAST({g} AS DOUBLE[]))" for r, g in quality.RULES.items())
_P = quality.RISK / len(quality.RULES)

#: The base measures by counting, and the cutoffs from binomial tails by log-gamma sums.
_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, doc_id, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'k': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM m),
twice AS (SELECT r, x.i AS i FROM (SELECT r, x, count(*) OVER (PARTITION BY r, x.k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
base AS (
  SELECT m.r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.r = cov.r),
sig AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         unnest([{{'rule': 'symbols', 'v': n_symbols / greatest(n_words, 1)}}, {{'rule': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1)}}, {{'rule': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)}},
                 {{'rule': 'long_words', 'v': word_chars / greatest(n_words, 1)}}, {{'rule': 'short_words', 'v': -word_chars / greatest(n_words, 1)}}], recursive := true)
  FROM base),
rules AS (SELECT * FROM (VALUES {_RULES}) AS t(rule, grid)),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT sig.*, quality FROM sig JOIN known USING (doc_id) WHERE NOT base_failed),
total AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS n FROM (SELECT DISTINCT r, lang, quality FROM held) GROUP BY lang),
tests AS (SELECT count(*) * {sum(map(len, quality.RULES.values()))} AS tests FROM total),
cuts AS (SELECT rule, grid, unnest(range(1, len(grid) + 1)) AS cut FROM rules),
rejected AS (SELECT lang, rule, cut, grid[cut] AS cutoff, CAST(sum(quality) AS BIGINT) AS k, CAST(sum(1 - quality) AS BIGINT) AS bad FROM held JOIN cuts USING (rule) WHERE v > grid[cut] GROUP BY ALL),
safe AS (
  SELECT x.lang, rule, cut, cutoff, bad - 10 * k AS gain FROM rejected x JOIN total t ON x.lang IS NOT DISTINCT FROM t.lang, tests
  WHERE k < n * {_P} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P})))) <= {quality.ERROR} / tests),
best AS (SELECT lang, rule, arg_max(cutoff, gain * 100 + cut) AS cutoff FROM safe WHERE gain > 0 GROUP BY lang, rule),
bad AS (SELECT DISTINCT r FROM sig JOIN best ON sig.rule = best.rule AND sig.lang IS NOT DISTINCT FROM best.lang WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base) b LEFT JOIN bad ON b.r = bad.r
"""

#: Every window of 200 bytes by its digest; the rows of a text are told apart by number.
_OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, i, md5_number(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM steps) GROUP BY r, g),
gaps AS (SELECT r, a, z, lag(z, 1, 1) OVER w AS before, lead(a) OVER w AS after FROM runs WINDOW w AS (PARTITION BY r ORDER BY a)),
pieces AS (SELECT r, before AS s, a - 1 AS e FROM gaps UNION ALL SELECT gaps.r, z, octet_length(b) FROM gaps JOIN d ON gaps.r = d.r WHERE after IS NULL),
kept AS (SELECT pieces.r, string_agg(hex(b[s:e]), '' ORDER BY s) AS h FROM pieces JOIN d ON pieces.r = d.r WHERE e >= s GROUP BY pieces.r),
sums AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN sums ON d.r = sums.r LEFT JOIN kept ON d.r = kept.r
"""

ORACLE = {"op2_suffix_dedup": _OP2, "op9_quality": _OP9, "op6_warc": _OP6, "op7_chat": _OP7, "op8_decontamination": _OP8}
