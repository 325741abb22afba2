"""DuckDB SQL that must give the same rows as the queries, where SQL can express them."""

WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM d
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY doc_id),
frequent AS (
  SELECT doc_id, max(times) AS most
  FROM (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL) GROUP BY doc_id),
s AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower
  FROM d),
f AS (
  SELECT s.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(most, 0) AS most
  FROM s LEFT JOIN repeated USING (doc_id) LEFT JOIN frequent USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 60 * len(lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * upper > upper + lower
            OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words OR 10 * most > 3 * n_words
            OR 2 * len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) > n_words) AS kept
FROM b
"""


def _kind(kind: str, pattern: str, valid: str, context: str = "", score: float = 1.0, whole: bool = False) -> str:
    """One row per valid match of ``pattern``; ``m`` is the match, ``b`` and ``a`` the gaps around it."""
    touch = "AND NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]')" if whole else ""
    near = (f"AND {score} + CASE WHEN regexp_matches(right(b, 40), '(?i){context}') THEN 0.3 ELSE 0.0 END >= 0.5"
            if context else "")
    return rf"""
  SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, ms[i] AS m, gs[i] AS b, gs[i + 1] AS a,
           CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) AS BIGINT)
           + CAST(coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d)))
  WHERE {valid} {near} {touch}"""


def _luhn(digits: str) -> str:
    double = "CASE WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END"
    return (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: "
            f"CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE {double} END)) % 10 = 0")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_PLAIN = "replace(m, ' ', '')"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_MOD97 = (f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''), "
          "lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS HUGEINT))), "
          "lambda r, v: (CASE WHEN v > 9 THEN r * 100 ELSE r * 10 END + v) % 97) = 1")


def _card(low: int, high: int) -> str:
    return f"CASE WHEN length({_DIGITS}) BETWEEN {low} AND {high} THEN {_luhn(_DIGITS)} ELSE false END"


_LISTED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT *, list_position(['email', 'ip', 'card', 'phone'], kind) AS k FROM (
  {_kind('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')} UNION ALL
  {_kind('ip', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+',
         "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) <= 255))")} UNION ALL
  {_kind('card', _CARD, _card(16, 19))} UNION ALL
  {_kind('phone', r'\+[0-9][\x20().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 8 AND 15')})),
more AS (SELECT *, 4 + list_position(['iban', 'national_id', 'card_short', 'phone_local'], kind) AS k FROM (
  {_kind('iban', r'[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)',
         f'CASE WHEN length({_PLAIN}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END', whole=True)} UNION ALL
  {_kind('national_id', r'[0-9]{3}-[0-9]{2}-[0-9]{4}', "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
         'ssn|social security|tax id', 0.3, True)} UNION ALL
  {_kind('card_short', _CARD, _card(13, 15), 'card|visa|amex|credit', 0.3, True)} UNION ALL
  {_kind('phone_local', r'\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}', 'true', 'phone|tel|call|mobile|fax', 0.3, True)})
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = doc_id AND base.s < e AND s < base.e)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM more)
SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce({_LISTED} FILTER (WHERE k <= 4), '')) AS base_sha256,
       coalesce({_LISTED}  FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    {WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s
    FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

OP11 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    {WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
    FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared FROM sized a JOIN sized b
  ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (total - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
named AS (
  SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
  FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM named
"""


def _crc32(number: str) -> str:
    """Unsigned checksum of a number written in decimal, bit by bit."""
    shifted = "list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda r, b: {shifted}))"


OP12 = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text)
                       ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS t FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, t, CAST({_crc32('conv_id')} % 4 AS BIGINT) AS h FROM own),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(base.t[1:h], []), h.t[h + 1:]) AS t
  FROM h LEFT JOIN own AS base ON base.conv_id = h.conv_id - h.conv_id % 20),
firsts AS (SELECT conv_id, t[1:d] AS prefix, d, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS listed
  FROM firsts GROUP BY prefix, d),
child AS (
  SELECT c.*, p.conv_id AS parent, (c.n - 1) * (CASE WHEN c.d = 0 THEN 0 ELSE len(regexp_extract_all(c.prefix[c.d].text, {WORDS})) END) AS saved
  FROM node c LEFT JOIN node p ON p.d = c.d - 1 AND p.prefix = c.prefix[1:c.d - 1]),
children AS (SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
counted AS (SELECT child.*, coalesce(n_children, 0) AS n_children FROM child LEFT JOIN children USING (prefix, d)),
subtree AS (
  SELECT prefix[1:up] AS prefix, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM counted) GROUP BY ALL)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(listed) AS ends_sha256
FROM counted JOIN subtree USING (prefix, d)
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, {_crc32('doc_id')} AS h FROM documents),
numbers AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
placed AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM numbers),
planted AS (
  SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM placed),
texts AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
         ELSE w END AS w FROM planted),
words AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
agree AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i
  WHERE 3 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT row, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM agree)
  GROUP BY row, q, island HAVING count(*) + q >= 24 AND count(*) >= 2 * q),
runs AS (
  SELECT row, s, len, q FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.row = x.row AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
listed AS (
  SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         list(struct_pack(s := s, len := len, q := q)) AS all_runs FROM runs GROUP BY row),
ranked AS (
  SELECT row, s, len, q, (1000 * len) // q AS milli,
         row_number() OVER (PARTITION BY row ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS place FROM runs),
collapsed AS (
  SELECT words.row, string_agg(word, ' ' ORDER BY i) AS body FROM words LEFT JOIN listed USING (row)
  WHERE all_runs IS NULL OR len(list_filter(all_runs, lambda r: i >= r.s + r.q AND i < r.s + r.len)) = 0 GROUP BY words.row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, milli AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (row) LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (row) LEFT JOIN collapsed USING (row)
"""
