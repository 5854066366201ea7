"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, compression, fm_dedup, html_text, importance, media, mixing, pieces_codec, prefix_trie, quality, simhash, suffix_dedup, token_counts
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces_codec.encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scored(table(spark, sf_dir, "documents"))


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), token_counts.sample_edits())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumn("too_long", F.col("longest_repeat") > quality.MAX_LONGEST).drop("longest_repeat")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sentencepiece, op2_html, op3_simhash, op4_suffix_dedup, op5_brown_lm, op6_fm_dedup, op7_mixing, op8_token_counts, op9_quality, op10_media, op11_importance, op12_prefix_trie, op13_compression)}

_WORD = r"[^\x20\x09-\x0D]"
#: Rows ``r`` (in the order of ids), their words and, one row each, ``p`` and ``w``.
_WORDS = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  l AS (SELECT doc_id, r, text, regexp_extract_all(text, '{_WORD}+') AS ws FROM d),
  w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM l)"""


def _windows_sql(name: str, size: int) -> str:
    """Starts ``p`` of the windows of ``size`` words, by row, with a digest."""
    return f"{name} AS (SELECT r, u.p, md5(array_to_string(ws[u.p : u.p + {size - 1}], ' ')) AS h FROM l, unnest(range(1, len(ws) - {size - 2})) AS u(p))"


def _covered_sql(name: str, windows: str, size: int) -> str:
    """Rows and places that windows of ``size`` words, which the row repeats, cover."""
    return f"""{name} AS (SELECT r, count(DISTINCT p + k.range) AS n FROM (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, h) AS c FROM {windows}) WHERE c > 1),
  range(0, {size}) k GROUP BY r)"""


_COUNTED = {"n_words": "len(ws)", "word_chars": "list_sum(list_transform(ws, lambda x: length(x)))", "n_symbols": "length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))"}
_LINES = f"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))"
_OP9 = f"""WITH {_WORDS}, {_windows_sql("a8", 8)}, {_windows_sql("am", quality.MIN_REPEAT)}, {_windows_sql("al", quality.MAX_LONGEST + 1)},
  {_covered_sql("c8", "a8", 8)}, {_covered_sql("cm", "am", quality.MIN_REPEAT)}, tl AS (SELECT DISTINCT r FROM (SELECT r, h FROM al GROUP BY 1, 2 HAVING count(*) > 1)),
  q AS (SELECT doc_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {c}" for c, x in _COUNTED.items())}, CAST(len({_LINES}) - len(list_distinct({_LINES})) AS BIGINT) AS n_dup_lines,
    coalesce(c8.n, 0) AS n_repeat_words, coalesce(cm.n, 0) AS covered_words, tl.r IS NOT NULL AS too_long FROM l LEFT JOIN c8 USING (r) LEFT JOIN cm USING (r) LEFT JOIN tl USING (r)),
  f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q)
  SELECT *, NOT base_failed AND 100 * covered_words <= {quality.MAX_COVERED_PERCENT} * n_words AND NOT too_long AS kept FROM f"""
_OP6 = f"""WITH {_WORDS}, {_windows_sql("a", fm_dedup.WINDOW)}, later AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY h ORDER BY r, p) AS k FROM a) WHERE k > 1),
  gone AS (SELECT DISTINCT r, p + k.range AS p FROM later, range(0, {fm_dedup.WINDOW}) k),
  t AS (SELECT w.r, count(*) AS n, count(gone.p) AS g, string_agg(w.w, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN t USING (r)"""
_OP4 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  a AS (SELECT r, u.p, md5(substring(x, 2 * u.p - 1, {2 * suffix_dedup.WINDOW})) AS h FROM d, unnest(range(1, length(x) // 2 - {suffix_dedup.WINDOW - 2})) AS u(p)),
  later AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM (SELECT r, p, row_number() OVER (PARTITION BY h ORDER BY r, p) AS k FROM a) WHERE k > 1),
  s AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + {suffix_dedup.WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM later),
  span AS (SELECT r, k, min(p) AS b, max(p) + {suffix_dedup.WINDOW - 1} AS e FROM s GROUP BY 1, 2),
  piece AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS last FROM span),
  t AS (SELECT r, count(*) AS n, sum(e - b + 1) AS g, string_agg(substring(x, 2 * last + 1, 2 * (b - last - 1)), '' ORDER BY b) AS kept, max(e) AS e FROM piece JOIN d USING (r) GROUP BY 1)
  SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""
#: What a byte makes of an empty CRC-32 register, for all bytes; and the checksum of a list of bytes.
_CRC_TABLE = f"""tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {importance.POLYNOMIAL}) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"""


def _crc_sql(n_bytes: str, byte_at: str) -> str:
    """The checksum of ``n_bytes`` bytes, of which number ``i`` is ``byte_at``; ``t`` is the table."""
    each = f"list_transform(range(1, {n_bytes} + 1), lambda i: CAST({byte_at} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {each}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP11_N, _OP11_M = importance.BUCKETS, importance.LONGEST_RUN
_OP11 = f"""WITH {_CRC_TABLE},
  x AS (SELECT 1 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 2, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
  l AS (SELECT side, r, doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM x),
  f AS (SELECT side, r, array_to_string(ws[u.p : u.p + k.range - 1], ' ') AS f FROM l, range(1, {_OP11_M + 1}) k, unnest(range(1, len(ws) + 2 - k.range)) AS u(p)),
  d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
  b AS (SELECT f, {_crc_sql("(length(x) // 2)", "('0x' || substring(x, 2 * i - 1, 2))")} % {_OP11_N} AS b FROM d, tab),
  c AS (SELECT b, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM f JOIN b USING (f) GROUP BY 1),
  g AS (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + {_OP11_N})) / ((s + 1) * ((SELECT sum(t) FROM c) + {_OP11_N})))) AS g FROM (SELECT b, s::DOUBLE AS s, t::DOUBLE AS t FROM c)),
  w AS (SELECT r, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 1 GROUP BY 1),
  o AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{importance.SEED}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM l LEFT JOIN w USING (r) WHERE side = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY words >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY words >= {importance.LEAST_WORDS}) AS n FROM o)
  SELECT doc_id, n_features, weight, score, CASE WHEN words >= {importance.LEAST_WORDS} AND k <= {importance.DRAWN_PERCENT} * n // 100 THEN k END AS rank FROM k"""
_OP12 = f"""WITH {_CRC_TABLE},
  own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS v FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  head AS (SELECT c, v, {_crc_sql("length(CAST(c AS VARCHAR))", "ord(substring(CAST(c AS VARCHAR), i, 1))")} % {prefix_trie.HEADS} AS h FROM own, tab),
  path AS (SELECT o.c, list_concat(coalesce(b.v, [])[1 : o.h], o.v[o.h + 1 : len(o.v)]) AS v FROM head o LEFT JOIN own b ON b.c = o.c - o.c % {prefix_trie.RUN}),
  mem AS (SELECT c, u.d, len(v) AS size, coalesce(length(v[u.d].t), 0) AS chars, md5(CAST(v[1 : u.d] AS VARCHAR)) || u.d AS k, CASE WHEN u.d > 0 THEN md5(CAST(v[1 : u.d - 1] AS VARCHAR)) || (u.d - 1) END AS p
    FROM path, unnest(range(0, len(v) + 1)) AS u(d)),
  node AS (SELECT k, any_value(d) AS d, any_value(p) AS p, any_value(chars) AS chars, min(c) AS least, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d) AS e FROM mem GROUP BY 1),
  kid AS (SELECT p AS k, count(*) AS kids FROM node WHERE p IS NOT NULL GROUP BY 1),
  below AS (SELECT m.k, sum((y.n - 1) * y.chars) AS saved, count(*) FILTER (kid.k IS NULL) AS leaves FROM node y LEFT JOIN kid USING (k) JOIN mem m ON m.c = y.least AND m.d <= y.d GROUP BY 1)
  SELECT n.least AS conv_id, CAST(n.d AS BIGINT) AS depth, q.least AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
  FROM node n JOIN below USING (k) LEFT JOIN kid USING (k) LEFT JOIN node q ON q.k = n.p"""
#: The others cannot be expressed in SQL as a whole (trees, trained models, vocabularies, XXH64, zlib); tests hold each against brute force.
ORACLES: dict[str, str] = {"op4_suffix_dedup": _OP4, "op6_fm_dedup": _OP6, "op9_quality": _OP9, "op11_importance": _OP11, "op12_prefix_trie": _OP12}
