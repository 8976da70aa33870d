"""Registered queries of this folder and their SQL; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flightloom.llm.binary_output import read_token_files, write_token_files
from flightloom.llm.codes import vector_codes
from flightloom.llm.common import table
from flightloom.llm.decontamination import contamination
from flightloom.llm.manifest import document_manifest
from flightloom.llm.near_dedup import near_classes
from flightloom.llm.packing import pack_along_curve
from flightloom.llm.pii import detect_pii
from flightloom.llm.quality import score_quality
from flightloom.llm.secret_scan import secret_report
from flightloom.llm.suffixes import passage_report
from flightloom.llm.topk import top_products
from flightloom.llm.toxicity import score_toxicity
from flightloom.llm.wrappers import extract_main_text


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3, 1, 0.7)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces without their ids; ids_crc32 stands for them."""
    return pack_along_curve(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 2048).drop("ids")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0, 0.3)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(table(spark, sf_dir, "documents"))


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_decontamination, op3_curve_packing, op4_near_duplicates, op5_token_files, op6_quality, op7_main_text,
        op8_pii, op9_top_products, op10_repeated_passages, op11_vector_codes, op12_manifest, op13_secret_scan,
    )
    return {f.__name__: f for f in own}


CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {CUT} AS w FROM documents),
b AS (SELECT item_id, {CUT} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS t FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(t) AS n FROM p),
x AS (SELECT r, i, n, w[i:i + n - 1] AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT DISTINCT r, i, n, item_id FROM x JOIN p USING (t)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""
TOP_PRODUCTS_SQL = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

NEAR = "(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))"


def codes_round(k: int) -> str:
    """Parts' nearest entries in round k, and the entries after it."""
    found = f"""a{k} AS (SELECT r, part, arg_min(e, {NEAR} * 16 + e) AS e, min({NEAR}) AS d FROM p JOIN b{k} USING (part) GROUP BY r, part)"""
    moved = f"""m{k} AS (SELECT part, e, list(s ORDER BY i) AS c FROM (SELECT part, e, i, floor(sum(x[i]) / count(*)) AS s FROM a{k} JOIN p USING (r, part), range(1, 1 + len(x)) AS u(i) GROUP BY part, e, i) GROUP BY part, e),
b{k + 1} AS (SELECT part, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e))"""
    return f"{found},\n{moved}"


CODES_SQL = f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, w[part * (len(w) // 8) + 1:(part + 1) * (len(w) // 8)] AS x FROM v, range(8) AS t(part)),
b0 AS (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 16),
{",".join(map(codes_round, range(7)))},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) FROM b6) AS codebooks_sha256 FROM f JOIN v USING (r)"""

MANIFEST_SQL = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, text,
  list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) AS crc,
  list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '') AS head FROM documents),
l AS (SELECT r, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS node,
  sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS start FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
tree AS (SELECT g, 0 AS level, pos, n, node FROM p
  UNION ALL SELECT g, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 8),
sub AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS node FROM sub
  UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8),
flank AS (SELECT a.g, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM tree a JOIN tree b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
high AS (SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
step AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY kind, level) AS k, before, after FROM (
  SELECT p.r, 1 AS kind, f.level, f.before, f.after FROM p JOIN flank f ON f.g = p.g AND f.pos = p.pos // CAST(power(8, f.level) AS BIGINT)
  UNION ALL SELECT p.r, 2, h.level, h.before, h.after FROM p JOIN sub USING (g) JOIN high h ON h.pos = sub.pos // CAST(power(8, h.level) AS BIGINT))),
fold AS (SELECT r, 0 AS k, start AS node FROM p UNION ALL SELECT r, step.k, sha256(before || node || after) FROM fold JOIN step USING (r) WHERE step.k = fold.k + 1),
proof AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS held FROM step GROUP BY r), end_ AS (SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, p.node AS leaf, subroot, t.node AS root, sha256(coalesce(held, '')) AS proof_sha256, folded_root, folded_root = t.node AS verified
FROM p JOIN sub USING (g) CROSS JOIN (SELECT node FROM top WHERE n = 1) t LEFT JOIN proof USING (r) JOIN end_ USING (r)"""


def cut_sql(kind: int, pattern: str, least: str) -> str:
    """Matches of a pattern with their places; x is the match, y its second group, b what stands between it and the last one."""
    return rf"""SELECT r, {kind} AS kind, start, start + length(x) AS stop, x, b FROM (
 SELECT *, sum(length(b)) OVER w + coalesce(sum(length(x)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
 SELECT r, unnest(range(1, 1 + len(xs))) AS i, unnest(xs) AS x, unnest(ys) AS y, unnest(bs[:len(xs)]) AS b FROM (
 SELECT r, regexp_extract_all(t, '{pattern}') AS xs, regexp_extract_all(t, '{pattern}', 1) AS ys, string_split_regex(t, '{pattern}') AS bs FROM d)) WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {least}"""


WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN_SQL = rf"""(?:{WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({cut_sql(0, ASSIGN_SQL, "length(y) >= 6")} UNION ALL {cut_sql(1, "(AKIA[A-Z0-9]+)", "length(x) >= 20")} UNION ALL {cut_sql(2, "([0-9a-f]+)", "length(x) >= 24")}),
runs AS ({cut_sql(3, "([A-Za-z0-9+/]+)", "length(x) >= 16")}),
mixed AS (SELECT * FROM runs WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')),
free AS (SELECT * FROM mixed WHERE NOT regexp_matches(x, '(?i)example|sample|placeholder|x{{8}}') AND NOT regexp_matches(x, '0123456789|abcdefghij|ABCDEFGHIJ')
 AND NOT regexp_matches(x, '^[A-Za-z]+[0-9]{{1,4}}$') AND NOT regexp_matches(b, '(?i)(sha-?(1|224|256|384|512)|md5|integrity|checksum)["'']?[:= -]{{1,3}}["'']?$') AND NOT regexp_matches(b, '(?i)base64,$')),
classed AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[^0-9a-fA-F]') THEN 16 ELSE 20 END AS w,
 CASE WHEN NOT regexp_matches(x, '[^0-9a-fA-F]') THEN 3.01 WHEN NOT regexp_matches(x, '[^0-9a-z]') OR NOT regexp_matches(x, '[^0-9A-Z]') THEN 3.61 WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') THEN 3.71 END AS bits FROM free),
high AS (SELECT r, kind, start + min(i) - 1 AS start, start + max(i) - 1 + w AS stop FROM (SELECT *, unnest(range(1, length(x) - w + 2)) AS i FROM classed WHERE bits IS NOT NULL)
 WHERE list_aggregate(string_split(substr(x, i, w), ''), 'entropy') >= bits GROUP BY r, kind, start, w),
spans AS (SELECT r, kind, start, stop FROM base UNION ALL SELECT r, kind, start, stop FROM high h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = h.r AND b.start < h.stop AND h.start < b.stop)),
said AS (SELECT r, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans FROM d LEFT JOIN said USING (r) GROUP BY r, doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; tests hold the others against brute force."""
    return {
        "op2_decontamination": DECONTAMINATION_SQL,
        "op9_top_products": TOP_PRODUCTS_SQL,
        "op11_vector_codes": CODES_SQL,
        "op12_manifest": MANIFEST_SQL,
        "op13_secret_scan": SECRETS_SQL,
    }
