"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from loomtext.llm.quality import BOILERPLATE, DIVIDERS, INNER_STOP, MENU, SYMBOLS, LineRules

OP4 = """
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda t: t <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda t: t <> '') AS w FROM benchmark
), pattern AS (
  SELECT * FROM (VALUES
    (0, 6, [0, 1, 3, 4, 5]), (1, 7, [0, 1, 2, 3, 6]), (2, 7, [0, 2, 4, 5, 6]),
    (3, 8, [0, 1, 2, 5, 7]), (4, 8, [0, 3, 4, 6, 7]), (5, 8, [0, 1, 4, 6, 7])
  ) AS p(number, span, offsets)
  UNION ALL
  SELECT 6 + n, n, range(n) FROM (SELECT DISTINCT len(w) AS n FROM item WHERE len(w) BETWEEN 1 AND 7)
), item_at AS (
  SELECT item_id, w, number, span, offsets, unnest(range(len(w) - span + 1)) AS p
  FROM item, pattern WHERE len(w) >= span AND (number < 6 AND len(w) >= 8 OR number >= 6 AND len(w) = span)
), item_key AS (
  SELECT item_id, w, number, span, p, least(p, 6) AS l, list_transform(offsets, lambda o: w[p + o + 1]) AS k FROM item_at
), doc_at AS (
  SELECT doc_id, w, number, offsets, unnest(range(len(w) - span + 1)) AS p FROM doc, pattern WHERE len(w) >= span
), doc_key AS (
  SELECT doc_id, w, number, p, list_transform(offsets, lambda o: w[p + o + 1]) AS k FROM doc_at
), hit AS (
  SELECT doc_id, item_id, d.w AS dw, i.w AS iw, d.p - l AS b, i.p - l AS s, l + 6 + span AS n
  FROM doc_key d JOIN item_key i ON d.number = i.number AND d.k = i.k
), overlap AS (
  SELECT doc_id, item_id, dw, iw, b, s, greatest(0, -b) AS lo, least(n, len(iw) - s, len(dw) - b) AS hi FROM hit
), compared AS (
  SELECT doc_id, item_id,
    len(list_filter(range(lo, hi), lambda j: dw[b + j + 1] = iw[s + j + 1]))::DOUBLE / (hi - lo)::DOUBLE AS share
  FROM overlap WHERE hi - lo >= least(12, len(iw))
)
SELECT doc_id, item_id, count(*) AS hits, max(share) AS similarity FROM compared WHERE share >= 0.75 GROUP BY doc_id, item_id
"""


# CRC-32 of the decimal id, one digit and one bit at a time.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12 = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT own.c, own.turns, ({CRC32.replace("c::VARCHAR", "own.c::VARCHAR")} % 4)::BIGINT AS h, base.turns AS first
  FROM own LEFT JOIN own AS base ON base.c = own.c - own.c % 20
), rebuilt AS (
  SELECT c, list_concat(CASE WHEN h > 0 THEN coalesce(first[1:h], []) ELSE [] END, turns[h + 1:len(turns)]) AS r FROM headed
), member AS (
  SELECT c, r, d, r[1:d] AS p FROM (SELECT c, r, unnest(range(len(r) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(r) = d), '')) AS ends_sha256
  FROM member GROUP BY d, p
), child AS (
  SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
), valued AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children,
    CASE WHEN node.d > 0 THEN (n_convs - 1) * len(list_filter(string_split_regex(node.p[node.d].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ELSE 0 END AS saved
  FROM node LEFT JOIN child ON node.d = child.d AND node.p = child.p
), below AS (
  SELECT up AS d, p[1:up] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS up FROM valued) GROUP BY 1, 2
)
SELECT v.conv_id, v.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN below ON below.d = v.d AND below.p = v.p
LEFT JOIN node parent ON v.d > 0 AND parent.d = v.d - 1 AND parent.p = v.p[1:v.d - 1]
"""


def word_list(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


# Words hold no space, so words joined by spaces stand for the sequence.
OP5 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, {word_list("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * common >= 75 * (sa.n + sb.n - common)
), reach AS (
  SELECT a AS x, a AS y FROM link
  UNION
  SELECT x, b FROM reach JOIN link ON y = a
), component AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component ON x = doc_id
"""

OP7 = f"""
WITH doc AS (
  SELECT doc_id, {word_list("text")} AS w FROM documents
), span AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), known AS (
  SELECT s, min(doc_id) AS least FROM span GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM span JOIN known USING (s) WHERE doc_id > least
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc
), judged AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN judged USING (doc_id)
"""


# Runs of a period are stretches of places whose word stands again that far on.
# Of equal stretches the smallest period counts: a run as long has its smallest
# period's whole stretch for all multiples of it.
OP13 = f"""
WITH drawn AS (
  SELECT doc_id, {word_list("text")} AS w, {CRC32.replace("c::VARCHAR", "doc_id::VARCHAR")}::BIGINT AS h FROM documents
), placed AS (
  SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM drawn
), doc AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM placed
), word AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM doc
), again AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM again) GROUP BY doc_id, p, island
), run AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretch WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id
), best AS (
  SELECT doc_id, start, length, period FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM run) WHERE place = 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), left_over AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS kept FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT doc.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM doc LEFT JOIN summed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, part: str) -> str:
    return f"(length({text}) - length(replace({text}, {_quoted(part)}, ''))) // {len(part)}"


def _op6(rules: LineRules) -> str:
    """The rules of a line, in the order in which the first one that fails counts."""
    boilerplate = " OR ".join(f"contains(lower(line), {_quoted(phrase)})" for phrase in BOILERPLATE)
    dividers, symbols = (" + ".join(_count("line", part) for part in parts) for parts in (DIVIDERS, SYMBOLS))
    stops = "[.!?…:;。！？][\"''”’»)\\]]*\\s*$"
    return f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, {word_list("text")} AS w FROM documents
), line AS (
  SELECT doc_id, line, place, {word_list("line")} AS own
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM doc)
), measured AS (
  SELECT *, len(own) AS n, {dividers} AS dividers, {symbols} AS symbols FROM line
), judged AS (
  SELECT *, CASE
    WHEN n = 0 THEN NULL
    WHEN {boilerplate} THEN 'boilerplate'
    WHEN dividers >= 2 AND n <= {rules.words_per_item} * (dividers + 1) OR n <= {rules.menu_words} AND regexp_matches(line, {_quoted("(?i)^[ ]*(?:" + MENU.pattern + ")")}) THEN 'navigation'
    WHEN symbols > {rules.symbols_per_word} * n THEN 'punctuation'
    WHEN regexp_matches(line, '{stops}') OR n >= {rules.prose_words} AND regexp_matches(line, {_quoted(INNER_STOP.pattern)}) THEN NULL
    ELSE 'punctuation' END AS failed FROM measured
), by_doc AS (
  SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
    count(*) FILTER (failed = 'punctuation') AS bad_punctuation, count(*) FILTER (failed = 'navigation') AS bad_navigation,
    count(*) FILTER (failed = 'boilerplate') AS bad_boilerplate,
    coalesce(sum(length(array_to_string(own, ''))) FILTER (failed IS NOT NULL), 0) AS lost_chars,
    string_agg(line, chr(10) ORDER BY place) FILTER (failed IS NULL) AS cleaned
  FROM judged GROUP BY doc_id
), three AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + shift) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM three), (SELECT unnest([0, 1, 2]) AS shift) WHERE times > 1 GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {" + ".join(_count("text", mark) for mark in SYMBOLS)} AS n_symbols,
    coalesce(repeated.n, 0) AS n_repeat_words FROM doc LEFT JOIN repeated USING (doc_id)
), base AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {rules.max_lost} * word_chars AS kept,
  n_lines, bad_punctuation, bad_navigation, bad_boilerplate, lost_chars::BIGINT AS lost_chars, sha256(coalesce(cleaned, '')) AS cleaned_sha256
FROM base JOIN by_doc USING (doc_id)
"""


def registry() -> dict[str, str]:
    return {
        "op4_spaced_seeds": OP4, "op5_tensored_minhash": OP5, "op6_line_rules": _op6(LineRules()), "op7_difference_cover": OP7,
        "op12_bitmap_trie": OP12, "op13_basic_factors": OP13,
    }
