"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from tessera.llm.queries import MIX_WEIGHTS, URL_RULES

_RULES = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in URL_RULES.items())

OP1 = f"""
WITH rules(rule, rhost, rpath, v) AS (VALUES {_RULES}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, 'allow') AS verdict
FROM parts LEFT JOIN LATERAL (
    SELECT rule, v FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    ORDER BY length(rule) DESC LIMIT 1) r ON true
"""

_UNIT = "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)"


def _draws(key: str, nodes: list[tuple[str, float]]) -> str:
    draws = ", ".join(f"{{'d': -ln({_UNIT.format(f'concat_ws(chr(124), 0, {chr(39)}{n}{chr(39)}, {key})')}) / {w}::DOUBLE, 'id': '{n}'}}" for n, w in nodes)
    return f"list_min([{draws}]).id"


def _tree(key: str, grown: bool) -> str:
    """The shard of ``key`` for 16 shards, or 17: two regions of two racks of four, and one of its own."""
    top = _draws(key, [("region0", 8), ("region8", 8)] + [("region16", 1)] * grown)
    rack = {a: _draws(key, [(f"rack{a}", 4), (f"rack{a + 4}", 4)]) for a in (0, 8)}
    leaf = {a: _draws(key, [(str(a + i), 1) for i in range(4)]) for a in (0, 4, 8, 12)}
    low = {a: f"CASE {rack[a]} WHEN 'rack{a}' THEN {leaf[a]} ELSE {leaf[a + 4]} END" for a in (0, 8)}
    return f"(CASE {top} WHEN 'region0' THEN {low[0]} WHEN 'region8' THEN {low[8]} ELSE '16' END)::INTEGER"


OP2 = f"""
WITH tab AS (
    SELECT list(x ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS x
        FROM range(256) r(i))),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
    SELECT text, strlen(text) + 1 AS size, xor(4294967295, list_reduce(
        list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM texts, tab),
keyed AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, size, text_crc32 FROM documents d JOIN crcs c ON coalesce(d.text, '') = c.text),
placed AS (
    SELECT doc_id, size, text_crc32, md5(concat_ws('|', k, text_crc32, size)) AS place,
        {_tree("k", False)} AS shard, {_tree("k", True)} AS grown_shard
    FROM keyed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY place, doc_id) - 1 AS slot, grown_shard
FROM placed
"""

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, text, coalesce(source, 'null') AS host, {_W} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {_SPACE}, '')) > 0) AS l FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, unnest([0, 1, 2]) u(o) GROUP BY r),
lines AS (SELECT DISTINCT r, k, host, text, regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '\x00', '') AS x FROM d, unnest(l) u(x)),
frequent AS (SELECT host, x FROM (SELECT DISTINCT k, host, text, x FROM lines) GROUP BY host, x HAVING count(*) > 20),
marked AS (SELECT r, len(string_split(x, ' ')) AS n, (host, x) IN (SELECT (host, x) FROM frequent) AS gone FROM lines),
left_ AS (SELECT r, sum(n) AS line_words, coalesce(sum(n) FILTER (gone), 0) AS removed_words FROM marked GROUP BY r),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(line_words, 0)::BIGINT AS line_words, coalesce(removed_words, 0)::BIGINT AS removed_words
    FROM d LEFT JOIN rep USING (r) LEFT JOIN left_ USING (r))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, line_words, removed_words,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND (removed_words = 0 OR (line_words - removed_words >= 50 AND line_words - removed_words >= 0.3::DOUBLE * line_words)) AS kept
FROM base
"""

_GIVEN = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in MIX_WEIGHTS.items())

OP7 = f"""
WITH RECURSIVE per AS (SELECT coalesce(source, 'null') AS s, count(*) AS n, CASE coalesce(source, 'null') {_GIVEN} ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY ALL),
rates AS (SELECT s, (SELECT sum(n) FROM per)::DOUBLE * w / ((SELECT sum(w) FROM per)::DOUBLE * n) AS rate FROM per),
cdf(s, rate, k, p, c) AS (
    SELECT s, rate, 0, exp(-rate), exp(-rate) FROM rates
    UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 20),
drawn AS (SELECT doc_id, source, coalesce(source, 'null') AS s, coalesce(doc_id::VARCHAR, 'null') AS id,
    {_UNIT.format("concat_ws('|', 0, 1, coalesce(doc_id::VARCHAR, 'null'))")} AS u FROM documents),
counted AS (SELECT doc_id, source, id, rate, (SELECT count(*) FROM cdf WHERE cdf.s = drawn.s AND u > c)::BIGINT AS copies FROM drawn JOIN rates USING (s))
SELECT doc_id, source, rate, copies, copy::BIGINT AS copy, md5(concat_ws('|', 'order0', id, copy)) AS order_key
FROM counted, unnest(range(copies)) u(copy)
"""

OP3 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(embedding) > 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

ORACLES = {"op1_url_filter": OP1, "op2_sharding": OP2, "op3_topk": OP3, "op4_quality_rules": OP4, "op7_mixing": OP7}
