"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .rules import RULES, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))


def _rule_sql() -> str:
    parts = []
    for r in RULES:
        if r.least is not None:
            parts.append(f"{r.metric} < {r.least}")
        if r.most is not None:
            parts.append(f"{r.metric} > {r.most}")
    return " OR ".join(parts)


RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, w, i FROM (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT k, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d))
),
per_word AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (w IN ({_STOP})) AS stops FROM w GROUP BY k),
tri AS (SELECT k, i, w AS a, lead(w) OVER (PARTITION BY k ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY k ORDER BY i) AS c FROM w),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
l AS (SELECT k, l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
per_line AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (regexp_matches(l, '^\s*[-*•·|]')) AS bullets, count(*) FILTER (regexp_matches(l, '(\.\.\.|…)\s*$')) AS ellipses FROM l GROUP BY k),
m AS (
  SELECT k, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets,
    coalesce(ellipses, 0) AS ellipses, coalesce(stops, 0) AS stops, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, length(t) - length(replace(t, '!', '')) AS exclamations
  FROM d LEFT JOIN per_word USING (k) LEFT JOIN per_line USING (k) LEFT JOIN covered USING (k)
),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0 END AS upper_ratio, CASE WHEN n_words > 0 THEN exclamations / n_words ELSE 0 END AS exclamation_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio, CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END AS bullet_ratio,
    CASE WHEN n_lines > 0 THEN ellipses / n_lines ELSE 0 END AS ellipsis_ratio
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({_rule_sql()}) AS kept
FROM r
"""


def _weights(column: str, weights: dict[str, int], other: int) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {v!r} THEN {w}' for v, w in weights.items())} ELSE {other} END" if weights else str(other)


def _share_sql(parent: str, name: str, budget: str, out: str, source: str) -> str:
    family = f"PARTITION BY {parent}" if parent else ""
    return f"""(
  SELECT * EXCLUDE (before, weights, place, full_, rest, open_rest, open_weights, open_place), (CASE WHEN open_place IS NULL OR place < open_place THEN capacity ELSE (weight * open_rest) // open_weights END)::HUGEINT AS {out} FROM (
    SELECT *, min(place) FILTER (NOT full_) OVER ({family}) AS open_place, arg_min(rest, place) FILTER (NOT full_) OVER ({family}) AS open_rest, arg_min(weights, place) FILTER (NOT full_) OVER ({family}) AS open_weights FROM (
      SELECT *, greatest({budget} - before, 0) AS rest, capacity * weights <= weight * greatest({budget} - before, 0) AS full_ FROM (
        SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights, row_number() OVER w AS place
        FROM {source} WINDOW w AS ({family} ORDER BY capacity::DOUBLE / weight, coalesce('=' || {name}, ''))))))"""


def mixing_sql(plan) -> str:
    """The SQL of mixing.copies for a plan whose budget is a share of all tokens."""
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, CASE WHEN right(source, 1) IN ('0', '1', '2') THEN 'web' WHEN right(source, 1) IN ('3', '4', '5') THEN 'books' WHEN right(source, 1) IN ('6', '7') THEN 'forums' WHEN right(source, 1) IN ('8', '9') THEN 'reference' ELSE 'other' END AS domain,
    coalesce(len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')), 0)::BIGINT AS n_tokens FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, (sum(n_tokens) * {plan.epochs})::HUGEINT AS capacity, {_weights('source', plan.source_weights, plan.other)} AS weight FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity, {_weights('lang', plan.lang_weights, plan.other)} AS weight FROM leaves GROUP BY domain, lang),
domains AS (SELECT domain, sum(capacity)::HUGEINT AS capacity, {_weights('domain', plan.domain_weights, plan.other)} AS weight,
    least((SELECT (sum(tokens)::HUGEINT * {plan.per_mille}) // 1000 FROM leaves), (SELECT sum(capacity)::HUGEINT FROM leaves)) AS root_budget FROM langs GROUP BY domain),
b1 AS {_share_sql('', 'domain', 'root_budget', 'domain_budget', 'domains')},
l1 AS (SELECT langs.*, domain_budget FROM langs JOIN b1 USING (domain)),
b2 AS {_share_sql('domain', 'lang', 'domain_budget', 'lang_budget', 'l1')},
l2 AS (SELECT leaves.*, lang_budget FROM leaves JOIN b2 ON leaves.domain = b2.domain AND leaves.lang IS NOT DISTINCT FROM b2.lang),
b3 AS {_share_sql('domain, lang', 'source', 'lang_budget', 'budget', 'l2')},
g AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b3),
o AS (
  SELECT d.*, g.budget::BIGINT AS budget, g.whole, g.budget - g.whole * g.tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{plan.seed}:' || (g.whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.domain = g.domain AND d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, domain, lang, source, n_tokens, budget, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
"""


_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group, least); patterns quoted for SQL.
_KINDS = (
    ("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 39), ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 20),
)


def _secrets_sql() -> str:
    each = []
    for rank, (kind, pattern, group, least) in enumerate(_KINDS):
        each.append(rf"""
  SELECT k, '{kind}' AS kind, {rank} AS rank, s AS start, s + m AS end_ FROM (
    SELECT k, i, g, m, (sum(b) OVER (PARTITION BY k ORDER BY i) + coalesce(sum(m) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM (
      SELECT k, unnest(list_transform(bs, lambda x: length(x))) AS b, unnest(list_concat(list_transform(ms, lambda x: length(x)), [NULL])) AS m, unnest(list_concat(list_transform(gs, lambda x: length(x)), [NULL])) AS g, unnest(range(len(bs))) AS i FROM (
        SELECT k, regexp_split_to_array(t, '{pattern}') AS bs, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE m IS NOT NULL AND g >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(each)}),
a AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank) AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (k)
"""


SECRETS_SQL = _secrets_sql()
