"""SQL of the queries on training text that SQL can express on whole tables."""

from quantloom.llm.textstats import COMMON, SPELLED

_LINES = r"""src AS (SELECT file, max(lower(trim(source))) AS s FROM corpus_index WHERE source IS NOT NULL GROUP BY 1),
l AS (SELECT file, s, unnest(string_split(body_text, chr(10))) AS line, unnest(range(1, len(string_split(body_text, chr(10))) + 1)) AS line_no FROM corpus_files JOIN src USING (file)),
k AS (SELECT file, s, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{L}]', '', 'g') AS k FROM l),
n AS (SELECT s, k FROM k WHERE length(k) >= 12 GROUP BY 1, 2 HAVING count(DISTINCT file) >= 6),
f AS (SELECT file, line_no FROM k JOIN n USING (s, k))"""
_BLOCKS = """c AS (SELECT file, s, k, lead(k) OVER (PARTITION BY file ORDER BY line_no) AS k2 FROM k WHERE length(k) >= 12),
e AS (SELECT s, k, k2 FROM c WHERE k != k2 GROUP BY 1, 2, 3 HAVING count(DISTINCT file) >= 6),
b AS (SELECT s, k AS x, k2 AS y FROM e UNION SELECT s, k2, k FROM e),
r AS (SELECT s, k AS x, k AS y FROM n UNION SELECT r.s, r.x, b.y FROM r JOIN b ON b.s = r.s AND b.x = r.y),
o AS (SELECT s, x AS k, min(y) AS block FROM r GROUP BY 1, 2),
m AS (SELECT s, k, count(DISTINCT file) AS n FROM k JOIN n USING (s, k) GROUP BY 1, 2),
z AS (SELECT s, block, count(*) AS n_lines, max(m.n) AS n_files FROM o JOIN m USING (s, k) GROUP BY 1, 2)"""

_NGRAMS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items)),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM g),
x AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w JOIN sizes ON len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id FROM x JOIN g USING (n, g))"""
_CUT = """places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w JOIN sizes ON len(w) >= n)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM places SEMI JOIN g USING (n, g))"""



def _spelled(text: str) -> str:
    """The text with every character of SPELLED as its plain one, lines apart by line feeds, without marks of quoted lines."""
    for pattern, by in (*SPELLED, ("\r\n?", "\n")):
        text = f"regexp_replace({text}, '{pattern}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    return rf"regexp_replace({text}, '(?m)^[ \t]*(?:>[ \t]+)+', '', 'g')"


_WS = r"[ \t\n\x0b\x0c\r]"
_STATISTICS = rf"""t AS (SELECT doc_id, {_spelled("text")} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \t\n\x0b\x0c\r]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0b\x0c\r]')) AS l,
  regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z[:^ascii:]]+') AS k FROM t),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(l) AS BIGINT) AS m, length(regexp_replace(t, '{_WS}', '', 'g')) AS size, len(k) AS nk,
  len(regexp_extract_all(t, '\.\.\.')) + len(regexp_extract_all(t, '#')) AS symbols,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?:]["'')\]]{{0,4}}{_WS}*$'))) AS final,
  len(list_filter(l, lambda x: regexp_matches(x, '^{_WS}*(?:(?:[-*+o"]|\[[xX]?\]|\(?(?:[0-9]{{1,3}}|[A-Za-z]|[ivx]{{1,5}})[.)]|[0-9]{{1,2}}:[0-9]{{2}}){_WS}+[^ \t\x0b\x0c\r]|\[{_WS}+\]{_WS}+[^ \t\x0b\x0c\r])'))) AS bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '\.\.\.{_WS}*$'))) AS dots, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z[:^ascii:]]'))) AS letters,
  len(list_filter(k, lambda x: x IN ({", ".join(repr(w) for w in dict.fromkeys(COMMON))}))) AS common FROM p)"""
_SHARES = ", ".join(
    f"CASE WHEN {of} > 0 THEN round(CAST({part} AS DOUBLE) / {of}, 6) ELSE 0.0 END AS {name}"
    for name, part, of in (
        ("mean_word_length", "size", "n"), ("symbols_per_word", "symbols", "n"), ("final_punctuation_lines", "final", "m"), ("bullet_lines", "bullets", "m"),
        ("ellipsis_lines", "dots", "m"), ("alphabetic_words", "letters", "n"), ("common_words", "common", "nk"),
    )
)

ORACLES = {
    "p3_found": f"WITH {_LINES} SELECT file, line_no FROM f",
    "p3_blocks": f"WITH RECURSIVE {_LINES},\n{_BLOCKS} SELECT n_lines, n_files, count(*) AS n_blocks FROM z GROUP BY 1, 2",
    "p3_cleaned": f"""WITH {_LINES}, t AS (SELECT file, count(*) AS n, list(line_no) AS taken FROM f GROUP BY 1)
SELECT file, coalesce(n, 0) AS n_removed, CASE WHEN n IS NULL THEN length(body_text) ELSE length(array_to_string(list_transform(
  list_filter(range(1, len(string_split(body_text, chr(10))) + 1), lambda i: NOT list_contains(taken, i)), lambda i: string_split(body_text, chr(10))[i]), chr(10))) END AS n_chars
FROM corpus_files LEFT JOIN t USING (file)""",
    "p6_found": f"WITH {_NGRAMS} SELECT doc_id, item_id FROM h",
    "p6_leaked_items": f"WITH {_NGRAMS} SELECT item_id, count(*) AS n_documents FROM h GROUP BY 1",
    "p6_cleaned": f"WITH {_NGRAMS},\n{_CUT} SELECT doc_id, count(*) AS n_words_removed FROM gone GROUP BY 1",
    "p8_statistics": f"WITH {_STATISTICS} SELECT doc_id, n AS n_words, m AS n_lines, {_SHARES} FROM c",
}
