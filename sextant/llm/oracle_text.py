"""DuckDB text of the operator queries that SQL can express."""

from sextant.llm import chat, decontaminate, lines, quality

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CASE WHEN f <> page_id AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id AND payload_bytes >= 100 THEN f END AS refers_to, payload_bytes, payload_digest FROM q"""


def _rule(rule: quality.Rule) -> str:
    parts = []
    if rule.low is not None:
        parts.append(f"{rule.numerator} >= {rule.low!r}::DOUBLE * {rule.denominator}")
    if rule.high is not None:
        parts.append(f"{rule.numerator} <= {rule.high!r}::DOUBLE * {rule.denominator}")
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, (x, lead(x) OVER o, lead(x, 2) OVER o) AS k, lead(x, 2) OVER o IS NOT NULL AS whole FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM r, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(map(_rule, quality.RULES))} AS kept FROM b"""

_CONTROL = f"{chat.END}{chat.START}assistant ok"
_FIXED = len(chat.START) + len(chat.END) + 2


def _escaped(column: str) -> str:
    """Code points of a text after escaping."""
    return (f"length({column}) + length({column}) - length(replace({column}, chr(92), ''))"
            f" + (length({column}) - length(replace({column}, '<|', ''))) // 2")


CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{_CONTROL}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_FIXED} + {_escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""WITH b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, w[k:k + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM bs)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, k, w[k:k + n - 1] AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n, k FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
p AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""

_BLANKS = " || ".join(f"chr({ord(c)})" for c in lines.BLANKS)
LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT k.*, coalesce(doc_id > first, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""

NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, list_dot_product(a.q, e.q)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
