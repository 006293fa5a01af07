"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

Compression, signatures, byte-pair merging, token files, the seeded mix and the iterated robust estimates have none; those
queries are tested against plain versions instead.
"""

from __future__ import annotations

from tallyweave.llm import decontam, secrets, warc

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
 bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 bwin AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item, w, least({decontam.WIDTH}, len(w)) AS k, unnest(range(1, len(w) - least({decontam.WIDTH}, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM bwin),
 dwin AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
 hits AS (SELECT rid, i, k, item FROM dwin JOIN bwin USING (k, s)),
 hw AS (SELECT rid, COUNT(DISTINCT p) AS hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
 hi AS (SELECT rid, COUNT(*) AS k_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(k_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
 FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

_REVISIT = "first IS NOT NULL AND page_id IS DISTINCT FROM first"

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= {warc.LEAST_REVISIT} GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN {_REVISIT} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {_REVISIT} THEN first END AS refers_to
 FROM p LEFT JOIN g USING (h)"""


#: The base patterns, with the least lengths of a run as its repetitions.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"


def _found(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """Spans {{s, k, e}} of all matches; `keep` says of match m with value v which stay."""
    quoted = pattern.replace("'", "''")
    before = f"coalesce(list_sum(list_transform(string_split_regex({text}, '{quoted}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{quoted}')[1:i - 1], lambda x: length(x))), 0)"
    value = f"regexp_extract_all({text}, '{quoted}', 2)[i]" if pattern == _ASSIGN else f"regexp_extract_all({text}, '{quoted}')[i]"
    size = f"length(regexp_extract_all({text}, '{quoted}')[i])"
    every = f"list_transform(range(1, len(regexp_extract_all({text}, '{quoted}')) + 1), lambda i: {{'s': ({before})::BIGINT, 'k': {kind}, 'e': ({before} + {size})::BIGINT, 'v': {value}}})"
    kept = f"list_filter({every}, lambda z: {keep})"
    return f"list_transform({kept}, lambda z: {{'s': z.s, 'k': z.k, 'e': z.e}})"


def _any(spans: str, condition: str) -> str:
    return f"len(list_filter({spans}, lambda o: {condition})) > 0"


_NEAR = f"o.s - z.e <= {secrets.SCOPE} AND z.s - o.e <= {secrets.SCOPE}"
_OVERLAP = "o.s < z.e AND z.s < o.e"
_KINDS = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"


def _listed(spans: str) -> str:
    return f"array_to_string(list_transform(list_sort({spans}), lambda z: {_KINDS}[z.k + 1] || ':' || z.s || ':' || z.e), ',')"


SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 a AS (SELECT doc_id, t, {_found("t", _ASSIGN, 0, "length(z.v) >= 12")} AS assign,
  {_found("t", _ASSIGN, 4, f"length(z.v) >= {secrets.LEAST_WEAK_VALUE} AND length(z.v) < 12")} AS short,
  {_found("t", _ACCESS, 1)} AS access, {_found("t", _HEX, 2)} AS hex,
  {_found("t", secrets.WEAK_SECRET, 4, "regexp_matches(z.v, '[0-9]') AND regexp_matches(z.v, '[A-Za-z]') AND NOT regexp_full_match(z.v, '[0-9a-f]+')")} AS rnd,
  {_found("t", secrets.WEAK_ID, 3)} AS ids, {_found("t", secrets.ENDPOINT, 5)} AS endpoint FROM t),
 b AS (SELECT *, list_concat(assign, access, hex) AS base FROM a),
 c AS (SELECT *, list_concat(short, list_filter(rnd, lambda z: NOT ({_any("base", _OVERLAP)}))) AS weak_secret, list_filter(ids, lambda z: NOT ({_any("base", _OVERLAP)})) AS weak_id FROM b),
 d AS (SELECT *, list_concat(assign, hex, weak_secret) AS secret, list_concat(access, weak_id) AS identifier FROM c),
 e AS (SELECT *, list_concat(list_filter(weak_id, lambda z: {_any("secret", _NEAR)}), list_filter(weak_secret, lambda z: {_any("identifier", _NEAR)} OR {_any("endpoint", _NEAR)}), list_filter(endpoint, lambda z: {_any("identifier", _NEAR)} AND {_any("secret", _NEAR)})) AS linked FROM d)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, sha256({_listed("base")}) AS base_sha256, {_listed("list_concat(base, linked)")} AS spans, len(linked)::BIGINT AS n_linked FROM e"""

SQL = {"op1_secrets": SECRETS, "op2_warc": WARC, "op10_decontamination": DECONTAMINATION}
