"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm.common import read_table
from viewloom.llm.conversation_repair import repairs
from viewloom.llm.decontamination import contamination
from viewloom.llm.language_id import language_id
from viewloom.llm.line_dedup import line_dedup
from viewloom.llm.merkle import manifest
from viewloom.llm.minhash_dedup import minhash_components
from viewloom.llm.piece_encoding import piece_encoding
from viewloom.llm.quality import COMMON, quality
from viewloom.llm.simhash_dedup import simhash_components
from viewloom.llm.suffix_dedup import suffix_dedup
from viewloom.llm.surrogates import pseudonymised
from viewloom.llm.token_counts import token_counts
from viewloom.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids", "lossless")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).drop("chars_distance", "common_distance")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read_table(spark, sf_dir, "documents"), key="of this query only").select("doc_id", "n_entities", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents")).drop("tampered")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(read_table(spark, sf_dir, "conversations"), planted=True)


_LINE_DEDUP = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS p, unnest(lines) AS line FROM d),
own AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS j, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
seq AS (SELECT doc_id, list(line ORDER BY j) AS lines, list(words ORDER BY j) AS words FROM own GROUP BY doc_id),
starts AS (SELECT *, unnest(range(len(lines))) AS a FROM seq),
runs AS (SELECT *, unnest(range(1, least(25, len(lines) - a) + 1)) AS n FROM starts),
long AS (SELECT doc_id, a, n, lines[a + 1:a + n] AS run FROM runs WHERE list_sum(words[a + 1:a + n]) >= 25),
again AS (SELECT doc_id, a, n FROM (SELECT doc_id, a, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM long) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS j FROM again),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN own ON own.doc_id = l.doc_id AND own.p = l.p LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.j = own.j WHERE gone.j IS NULL GROUP BY l.doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
losses AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(losses.n, 0) AS BIGINT) AS n_removed, CASE WHEN x.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents x LEFT JOIN kept ON kept.doc_id = x.doc_id LEFT JOIN sizes ON sizes.doc_id = x.doc_id LEFT JOIN losses ON losses.doc_id = x.doc_id"""

_QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
runs AS (SELECT doc_id, i, words[i:i + 4] AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, length(text) AS size,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')) AS marks, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS wide
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
c AS (SELECT doc_id, lang, n_words, 'chars' AS h, unnest(range(7)) AS k, unnest([size - word_chars, word_chars - n_symbols - upper - digits - marks - wide, upper, wide, marks, digits, n_symbols]) AS n FROM m),
k AS (SELECT doc_id, lang, n_words, 'common' AS h, unnest(range(len(COMMON_WORDS) + 1)) AS k, unnest(list_append(list_transform(COMMON_WORDS, lambda c: len(list_filter(words, lambda x: x = c))), len(list_filter(words, lambda x: NOT list_contains(COMMON_WORDS, x))))) AS n FROM m),
a AS (SELECT doc_id, lang, h, k, CAST(n AS DOUBLE) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM k) WHERE n_words >= 50),
r AS (SELECT a.lang, h, k, sum(n) AS n FROM a JOIN m ON m.doc_id = a.doc_id WHERE 100 * n_repeat_words <= 20 * n_words GROUP BY 1, 2, 3),
p AS (SELECT doc_id, a.h, a.n / sum(a.n) OVER (PARTITION BY doc_id, a.h) AS x, r.n / sum(r.n) OVER (PARTITION BY doc_id, a.h) AS y FROM a JOIN r ON a.lang = r.lang AND a.h = r.h AND a.k = r.k),
j AS (SELECT doc_id, h, sqrt(greatest(0, sum((CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2))) AS js FROM p GROUP BY 1, 2),
far AS (SELECT j.doc_id, bool_or(js > CASE h WHEN 'chars' THEN 0.25 ELSE 0.2 + sqrt(10 / (8 * ln(2) * n_words)) END) AS far FROM j JOIN m ON m.doc_id = j.doc_id GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(far.far, false) AS kept
FROM m LEFT JOIN far ON far.doc_id = m.doc_id""".replace("COMMON_WORDS", str(COMMON))

_MANIFEST = r"""WITH RECURSIVE bits AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(b))),
d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, a: xor(bits.t[xor(c, a) % 256 + 1], c // 256)), CAST(4294967295 AS BIGINT)) % 3 = 0 AS struck FROM documents, bits),
l AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN struck THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM d),
nodes AS (SELECT g, 0 AS lvl, i, leaf AS digest, n FROM l UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 8, n),
subs AS (SELECT g, lvl, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, i, digest, n FROM subs UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, i // 8, n),
near AS (SELECT g, lvl, i, coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM nodes WHERE n > 1),
over_ AS (SELECT lvl, i, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM tops WHERE n > 1),
path AS (SELECT l.g, l.i, near.lvl, near.lft, near.rgt FROM l JOIN near ON near.g = l.g AND near.i = l.i // CAST(8 ** near.lvl AS BIGINT) UNION ALL SELECT l.g, l.i, subs.lvl + over_.lvl, over_.lft, over_.rgt FROM l JOIN subs ON subs.g = l.g JOIN over_ ON over_.i = subs.i // CAST(8 ** over_.lvl AS BIGINT)),
fold AS (SELECT g, i, 0 AS lvl, coalesce(other, leaf) AS digest FROM l UNION ALL SELECT fold.g, fold.i, fold.lvl + 1, sha256(path.lft || fold.digest || path.rgt) FROM fold JOIN path ON path.g = fold.g AND path.i = fold.i AND path.lvl = fold.lvl),
ends AS (SELECT g, i, max_by(digest, lvl) AS folded_root FROM fold GROUP BY g, i),
proof AS (SELECT g, i, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof_sha256 FROM path GROUP BY g, i),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, subs.digest AS subroot, root.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, ends.folded_root, ends.folded_root = root.root AS verified
FROM l JOIN subs ON subs.g = l.g JOIN ends ON ends.g = l.g AND ends.i = l.i LEFT JOIN proof ON proof.g = l.g AND proof.i = l.i, root"""

_MINHASH = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 OR words IS NULL THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
arcs AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM arcs UNION SELECT reach.u, arcs.v FROM reach JOIN arcs ON arcs.u = reach.v),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.v, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least.v, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.u = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _LINE_DEDUP, "op7_quality_rules": _QUALITY, "op11_merkle_manifest": _MANIFEST, "op12_minhash_near_dedup": _MINHASH}
