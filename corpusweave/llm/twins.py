"""SQL twins of the operators whose results plain SQL can give, by all pairs and step by step; for DuckDB."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
WORDS = rf"regexp_extract_all({{}}, '[^\x20\x09-\x0D]+')"
#: One row with the 256 values of the byte-wise CRC-32; and the CRC of the bytes of an ASCII or Latin-1 string.
CRC_TABLE = ("SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), "
             "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i))")
_BYTES = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END))"
CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295)"

SPELLING = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents) GROUP BY doc_id, run),
h AS (SELECT run, n, {CRC.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, left(word, i - 1) AS front, substr(word, i + 1) AS back FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
shorter AS (SELECT DISTINCT c.word, w.word AS other FROM cuts c JOIN w ON w.word = c.front || c.back),
near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.front = b.front AND a.back = b.back AND a.word <> b.word
    UNION SELECT word, other FROM shorter UNION SELECT other, word FROM shorter),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(a := -w.n, b := other)) AS other, max(w.n) AS other_n FROM near JOIN w ON w.word = other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f AS last ON last.word = r.at AND last.form IS NULL"""

BOTTOM_K = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
g AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
one AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (n + m - c)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b),
least_id AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM s LEFT JOIN least_id USING (doc_id)"""


def _more(state: str, cost: str, edit: str) -> str:
    """A state's cheapest list of edits, as its cost in 8 digits and then its initials, with one more."""
    return f"lpad(CAST(CAST(left({state}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9) || '{edit}'"


def _step() -> str:
    free = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
    truncated = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN {free} AND initial = '{initial}' THEN {_more(state, truncated, 'K')} END"

    def given(state: str) -> str:
        return f"CASE WHEN {free} THEN {_more(state, f'2 + {truncated}', 'R')} END"

    users = ", ".join(f(q, *x) for q in ("n", "s", "a") for f, x in ((kept, ("u",)), (given, ())))
    return (f"{_more('n', '3', 'D')} AS n, least({_more('s', '3', 'D')}, {kept('n', 's')}) AS s, least({_more('u', '3', 'D')}, {users}) AS u, "
            f"least({_more('a', '3', 'D')}, {kept('u', 'a')}, {given('u')}) AS a")


_U = f"least(u, {_more('n', '2', 'I')}, {_more('s', '2', 'I')}, {_more('a', '2', 'I')})"
_WITH_INSERTS = f"SELECT conv_id, rank, n, s, u, least(a, {_more('u', '2', 'I')}) AS a FROM (SELECT conv_id, rank, n, s, {_U} AS u, a FROM {{}})"
_FIRST = f"SELECT conv_id, CAST(0 AS BIGINT) AS rank, '00000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM f)"

TURNS = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rank, rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS words FROM damaged),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN words = '' THEN 'blank' WHEN rank > min(rank) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
    WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ranked),
dp AS ({_WITH_INSERTS.format(f"({_FIRST})")}
    UNION ALL {_WITH_INSERTS.format(f"(SELECT conv_id, f.rank, {_step()} FROM dp JOIN f USING (conv_id) WHERE f.rank = dp.rank + 1)")}),
best AS (SELECT conv_id, CAST(left(v, 8) AS BIGINT) AS cost, substr(v, 9) AS audit FROM (SELECT dp.conv_id, least(n, a) AS v FROM dp JOIN (SELECT conv_id, max(rank) AS rank FROM f GROUP BY conv_id) USING (conv_id, rank))),
walk AS (SELECT conv_id, audit, CAST(0 AS BIGINT) AS rank, 'n' AS q, CAST([] AS VARCHAR[]) AS out FROM best
    UNION ALL SELECT conv_id, substr(audit, 2), CASE WHEN left(audit, 1) = 'I' THEN walk.rank ELSE walk.rank + 1 END,
        CASE left(audit, 1) WHEN 'D' THEN q WHEN 'K' THEN f.initial ELSE CASE q WHEN 'u' THEN 'a' ELSE 'u' END END,
        CASE left(audit, 1) WHEN 'D' THEN out WHEN 'K' THEN list_append(out, f.role || ':' || f.text)
            ELSE list_append(out, CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE left(audit, 1) WHEN 'R' THEN f.text ELSE '' END) END
    FROM walk LEFT JOIN f USING (conv_id) WHERE audit <> '' AND CASE WHEN left(audit, 1) = 'I' THEN f.rank = 1 ELSE f.rank = walk.rank + 1 END),
pairs AS (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY rank) || initial AS pair FROM f),
bad AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts USING (conv_id) LEFT JOIN bad USING (conv_id) LEFT JOIN best USING (conv_id)
LEFT JOIN (SELECT conv_id, out FROM walk WHERE audit = '') done USING (conv_id)"""
