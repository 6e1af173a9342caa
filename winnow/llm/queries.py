"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from winnow.llm import (
    bpe, decontamination, grid_join, language, merkle, near_dedup, neighbours, periodic, quality, sharding, substring_dedup, url_filter, wrappers,
)

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.round_trips(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering_found(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_sharding, op2_html_extraction, op3_minhash_near_dedup, op4_quality_classifier, op5_language_id, op6_url_filters,
             op7_benchmark_decontamination, op8_substring_dedup, op9_nearest_neighbours, op10_byte_level_bpe, op11_merkle_manifest, op12_embedding_near_dedup, op13_periodic_runs]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_WINDOWS_7 = """
WITH words_of AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
starts AS (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item, array_to_string(ws[s:s + 9], ' ') AS w, least(10, len(ws)) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM words_of, sizes WHERE len(ws) >= n),
found AS (SELECT p.doc_id, p.s, p.n, w.item FROM places p JOIN wins w ON w.n = p.n AND w.w = array_to_string(p.ws[p.s:p.s + p.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WINDOWS_8 = """
WITH words_of AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM words_of WHERE len(ws) >= 35),
wins AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS w FROM starts),
twice AS (SELECT w FROM wins GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM wins JOIN twice USING (w)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM words_of),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM words_of d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_LINKS_3 = """
WITH RECURSIVE words_of AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda s: md5(array_to_string(ws[s:s + 4], ' ')))) AS sh
  FROM words_of WHERE len(ws) > 0),
classes AS (SELECT doc_id, sh, len(sh) AS n, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM sets),
items AS (SELECT doc_id AS id, n, unnest(sh) AS h FROM classes WHERE doc_id = rep),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM items a JOIN items b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, low) AS (SELECT id, id FROM (SELECT DISTINCT id FROM items) UNION SELECT w.b, r.low FROM reach r JOIN ways w ON w.a = r.id WHERE r.low < w.b),
lows AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT w.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(l.low, w.doc_id) AS component_id, coalesce(l.low, w.doc_id) = w.doc_id AS kept
FROM words_of w LEFT JOIN classes c USING (doc_id) LEFT JOIN lows l ON l.id = c.rep
"""


#: crc32 of an ASCII string by its table; ``crc(<text>)`` below.
_CRC = """
crc_steps AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS t FROM range(256) r(b)),
crc_table AS (SELECT list(t ORDER BY b) AS tab FROM crc_steps),
crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""


def _counted(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_counted, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_MANIFEST_11 = f"""
WITH RECURSIVE {_CRC.strip()},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS altered
  FROM documents LEFT JOIN crcs USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up(g, lvl, i, n, d) AS (
  SELECT g, 0, i, n, leaf FROM placed
  UNION ALL SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, lvl, i // 2, n),
groups AS (SELECT g, lvl AS height, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gn FROM up WHERE n = 1),
crown(lvl, i, n, d) AS (
  SELECT 0, gi, gn, subroot FROM groups
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n),
top AS (SELECT d AS root, lvl AS tall FROM crown WHERE n = 1),
steps AS (
  SELECT p.g, p.i AS place, l.lvl AS step, coalesce(u.d, '') AS d, (p.i >> l.lvl) % 2 = 1 AS on_left
  FROM placed p JOIN groups USING (g), range(64) l(lvl) LEFT JOIN up u ON u.g = p.g AND u.lvl = l.lvl AND u.i = xor(p.i >> l.lvl, 1) WHERE l.lvl < height
  UNION ALL
  SELECT p.g, p.i, height + l.lvl, coalesce(c.d, ''), (gi >> l.lvl) % 2 = 1
  FROM placed p JOIN groups USING (g), top, range(64) l(lvl) LEFT JOIN crown c ON c.lvl = l.lvl AND c.i = xor(gi >> l.lvl, 1) WHERE l.lvl < tall),
proofs AS (SELECT g, place, string_agg(d, '' ORDER BY step) AS proof FROM steps GROUP BY g, place),
fold(g, place, step, d) AS (
  SELECT g, i, 0, altered FROM placed
  UNION ALL SELECT f.g, f.place, f.step + 1, CASE WHEN on_left THEN sha256(s.d || f.d) ELSE sha256(f.d || s.d) END FROM fold f JOIN steps s USING (g, place, step)),
ends AS (SELECT g, place, arg_max(d, step) AS folded FROM fold GROUP BY g, place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed p JOIN groups USING (g) JOIN ends e ON e.g = p.g AND e.place = p.i LEFT JOIN proofs q ON q.g = p.g AND q.place = p.i, top
"""

_LINKS_12 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS r FROM embeddings),
fit AS (
  SELECT *, len(v) AS dim FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
pairs AS (SELECT a.r AS a, b.r AS b, a.vec_id AS ida, b.vec_id AS idb FROM fit a JOIN fit b ON a.dim = b.dim AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
counts AS (SELECT a AS r, count(*) AS n FROM pairs GROUP BY a),
reach(r, low) AS (SELECT r, vec_id FROM fit UNION SELECT p.b, q.low FROM reach q JOIN pairs p ON p.a = q.r WHERE q.low < p.idb),
lows AS (SELECT r, min(low) AS low FROM reach GROUP BY r)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM vectors LEFT JOIN counts USING (r) LEFT JOIN lows USING (r)
"""

_RUNS_13 = f"""
WITH {_CRC.strip()},
split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
drill AS (
  SELECT r, doc_id, ws, len(ws) AS n, crc % 10 = 0 AND len(ws) > 0 AS hit, CASE WHEN len(ws) > 0 THEN (crc // 10) % len(ws) END AS a,
    CASE WHEN len(ws) > 0 THEN 1 + (len(ws) - (crc // 10) % len(ws)) // (3 + (crc // 10) % 8) END AS p
  FROM split LEFT JOIN crcs USING (doc_id)),
words AS (
  SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM drill),
starts AS (SELECT r, ws, unnest(range(0, n - 5)) AS i FROM words WHERE n >= 12),
sixes AS (SELECT r, i, hash(array_to_string(ws[i + 1:i + 6], ' ')) AS w, array_to_string(ws[i + 1:i + 6], ' ') AS t FROM starts),
near AS (SELECT x.r, x.i, y.i - x.i AS q FROM sixes x JOIN sixes y ON y.r = x.r AND y.w = x.w AND y.i > x.i AND y.t = x.t),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS o FROM near),
spans AS (SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM islands GROUP BY r, q, o),
runs AS (SELECT r, s, e, min(q) AS q FROM spans WHERE e - s >= greatest(12, 2 * q) GROUP BY r, s, e),
best AS (SELECT r, count(*) AS n_runs, first(struct_pack(s := s, l := e - s, q := q) ORDER BY e - s DESC, s, q) AS b, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
each AS (SELECT r, unnest(ws) AS word, unnest(range(n)) AS i FROM words),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM words LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def oracles() -> dict[str, str]:
    """SQL for the queries whose results do not depend on a model, a forest or a vocabulary."""
    return {
        "op3_minhash_near_dedup": _LINKS_3, "op7_benchmark_decontamination": _WINDOWS_7, "op8_substring_dedup": _WINDOWS_8,
        "op11_merkle_manifest": _MANIFEST_11, "op12_embedding_near_dedup": _LINKS_12, "op13_periodic_runs": _RUNS_13,
    }
