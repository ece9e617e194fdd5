"""DuckDB SQL for the queries of this package that SQL can express."""

OP3 = """
WITH p AS (
 SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
 FROM pages
), f AS (
 SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
 CASE WHEN f.first IS NOT NULL AND payload_bytes >= 100 AND (page_id IS NULL OR page_id <> f.first) THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN f.first IS NOT NULL AND payload_bytes >= 100 AND (page_id IS NULL OR page_id <> f.first) THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

OP5 = r"""
WITH d AS (
 SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
 SELECT rid, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters,
  len(regexp_extract_all(t, '[|]')) AS n_bars, len(regexp_extract_all(t, '!')) AS n_shouts FROM d
), l AS (
 SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), lc AS (
 SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
 FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), g AS (
 SELECT rid, i, list_slice(w, i, i + 2) AS k
 FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
 SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1
), rc AS (
 SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) o(j) GROUP BY rid
), a AS (
 SELECT m.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM m LEFT JOIN lc USING (rid) LEFT JOIN rc USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)
  OR (n_letters >= 50 AND 2 * n_upper > n_letters) OR 5 * n_bars > n_words OR 4 * n_shouts > n_words
  OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))) AS kept
FROM b
"""

OP6 = r"""
WITH d AS (
 SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
 SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS nth
 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), g AS (
 SELECT DISTINCT doc_id, i + j AS i FROM v, (SELECT unnest(range(0, 20)) AS j) WHERE nth > 1
), k AS (
 SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), t AS (
 SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.i
 WHERE g.i IS NULL GROUP BY k.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP7 = r"""
WITH RECURSIVE d AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
 FROM documents
), s AS (
 SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_slice(w, i, i + 1) END AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), df AS (SELECT k, count(*) AS f FROM s GROUP BY k
), o AS MATERIALIZED (
 SELECT s.doc_id, s.k, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.k) AS at, n.n
 FROM s JOIN df USING (k) JOIN n USING (doc_id)
), c AS (
 SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM o a JOIN o b ON a.k = b.k AND a.doc_id < b.doc_id
 WHERE 5 * a.at <= a.n + 5 AND 5 * b.at <= b.n + 5 AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), e AS MATERIALIZED (
 SELECT x, y FROM (
  SELECT c.x, c.y, count(*) AS i FROM c JOIN s a ON a.doc_id = c.x JOIN s b ON b.doc_id = c.y AND b.k = a.k GROUP BY c.x, c.y)
 JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 80 * (na.n + nb.n - i)
), b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e
), r AS (
 SELECT doc_id, doc_id AS seen FROM n
 UNION
 SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.seen
), m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
 d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM (SELECT doc_id FROM documents) d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP9 = r"""
WITH p AS (
 SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
 SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), v AS (
 SELECT *, CASE
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE
 WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(casino|porn|viagra|xxx)([^A-Za-z0-9]|$)') THEN 'block'
 ELSE 'allow' END AS verdict
FROM v
"""

#: The table of the reflected polynomial, by which a checksum is a fold over the bytes.
CRC = """crc AS (
 SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 of ``text``, an SQL expression; reads ``crc``."""
    code = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda a, y: xor(a // 256, tab[1 + xor(a % 256, y)])), 4294967295)"


def _after(edit: str, cost: str, state: str, line: str | None = None) -> str:
    """The repair ``state`` with one more edit, as a value that is ordered by (cost, audit)."""
    out = f"r.{state}.o" if line is None else f"r.{state}.o || chr(10) || {line}"
    return f"{{'c': r.{state}.c + {cost}, 'a': r.{state}.a || '{edit}', 'o': {out}}}"


def _insert(state: str, role: str) -> str:
    return f"{{'c': {state}.c + 2, 'a': {state}.a || 'I', 'o': {state}.o || chr(10) || '{role}:'}}"


_FAR = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"
_START = "{'c': 0::BIGINT, 'a': '', 'o': ''}"


def _turn(state: str, froms: tuple[str, ...], initial: str, role: str | None) -> str:
    """Least repair that ends in ``state`` after the row: it is deleted, kept or reroled."""
    kept = f"CASE WHEN n.f < 2 AND n.i = '{initial}' THEN [{', '.join(_after('K', 'n.f', q, 'n.line') for q in froms)}] ELSE [] END"
    all_ = f"list_concat([{_after('D', '3', state)}], {kept})"
    if role:
        reroled = ", ".join(_after("R", "2 + n.f", q, f"'{role}:' || n.text") for q in froms)
        all_ = f"list_concat({all_}, CASE WHEN n.f < 2 THEN [{reroled}] ELSE [] END)"
    return f"list_min({all_}) AS {state}"


OP11 = rf"""
WITH RECURSIVE {CRC}, d AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc
), e AS (
 SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d
), g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), o AS (
 SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS pos
 FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
), f AS (
 SELECT *, left(role, 1) AS i, role || ':' || text AS line, CASE
   WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3
   WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 2
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS f,
  lag(left(role, 1)) OVER (PARTITION BY g ORDER BY pos) AS before FROM o
), r AS (
 SELECT g, 0 AS pos, {_START} AS s0, {_FAR} AS s1, {_insert(_START, "user")} AS s2, {_insert(_insert(_START, "user"), "assistant")} AS s3 FROM g
 UNION ALL
 SELECT g, pos, s0, s1, s2, list_min([s3, {_insert("s2", "assistant")}]) AS s3 FROM (
  SELECT g, pos, s0, s1, list_min([s2, {_insert("s0", "user")}, {_insert("s1", "user")}, {_insert("s3", "user")}]) AS s2, s3 FROM (
   SELECT r.g AS g, r.pos + 1 AS pos, {_turn("s0", (), "", None)}, {_turn("s1", ("s0",), "s", None)},
    {_turn("s2", ("s0", "s1", "s3"), "u", "user")}, {_turn("s3", ("s2",), "a", "assistant")}
   FROM r JOIN f AS n ON n.g = r.g AND n.pos = r.pos + 1))
), z AS (
 SELECT g, list_min([s0, s3]) AS b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos DESC) AS last FROM r) WHERE last = 1
), c AS (
 SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 3) AS blank, count(*) FILTER (f = 2) AS duplicate,
  count(*) FILTER (f = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
 FROM f GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256
FROM g JOIN z ON z.g = g.g LEFT JOIN c ON c.g = g.g
"""

OP13 = rf"""
WITH RECURSIVE {CRC}, r AS (
 SELECT k, run, count(*) AS c FROM (
  SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
 GROUP BY k, run
), h AS (SELECT run, c, {crc32("k || ':' || run")} AS h FROM r, crc
), w AS MATERIALIZED (
 SELECT word, sum(c)::BIGINT AS n FROM (
  SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
 WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), s AS MATERIALIZED (
 SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), p AS MATERIALIZED (
 SELECT DISTINCT u, v, nv FROM (
  SELECT a.word AS u, b.word AS v, b.n AS nv FROM s a JOIN s b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = s.short
  UNION ALL SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = s.short)
), b AS (
 SELECT u, count(*) AS n_near, max(nv) AS most, min({{'less': -nv, 'v': v}}).v AS best FROM p GROUP BY u
), f AS MATERIALIZED (
 SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN best END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
 FROM w LEFT JOIN b ON b.u = w.word
), t AS (
 SELECT word, word AS root, form AS next FROM f
 UNION ALL
 SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next
)
SELECT f.word AS word, f.form AS form, t.root AS root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""

ORACLE = {
    "op3_warc": OP3,
    "op5_quality_rules": OP5,
    "op6_substring_dedup": OP6,
    "op7_minmax_near_duplicates": OP7,
    "op9_url_filters": OP9,
    "op11_conversation_repair": OP11,
    "op13_spelling_variants": OP13,
}
