"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written from the semantics, not from the Spark plans: fixture views
are re-derived from the base tables, and Spark's array programs are replaced by
window functions, joins and grouping over exploded rows.
"""

from __future__ import annotations

import re

from citegraph.plans.fixtures import LAST_PAGE

def tid(expr: str) -> str:
    """Title key: MD5 of the simplified title (of the title, if that is empty), first 8 bytes as a signed long."""
    simple = f"lower(regexp_replace(regexp_replace({expr}, '(proc\\..*|proceedings.*)', '', 'g'), '[^a-zA-Z+]', '', 'g'))"
    v = f"CAST('0x' || substr(md5(coalesce(nullif({simple}, ''), 'title:' || {expr})), 1, 16) AS UBIGINT)"
    return (
        f"CAST(CASE WHEN {v} >= 9223372036854775808 THEN CAST({v} AS HUGEINT) - 18446744073709551616 "
        f"ELSE CAST({v} AS HUGEINT) END AS BIGINT)"
    )


PAPERS = f"""
papers AS (
  SELECT doc_id, title, n_chars, text,
         'http://papers.example/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.ps' ELSE '.pdf' END AS url,
         CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i,
         count(*) OVER () AS n,
         {tid('title')} AS id
  FROM (SELECT *, CASE WHEN length(line) > 149 THEN trim(substr(line, 1, 149))
                       WHEN length(line) < 11 THEN trim(line || ' Document number ' || doc_id) ELSE line END AS title
        FROM (SELECT *, trim(regexp_replace(split_part(text, chr(10), 1), '[.?()\\s]+', ' ', 'g')) AS line FROM documents))
),
refs AS (
  SELECT e.doc_id AS citing_id, CAST(e.j AS INTEGER) AS pos, q.title AS cited_title, e.i AS citing_i
  FROM (SELECT doc_id, i, n, unnest(range(0, CAST(i % 4 AS BIGINT) + 1)) AS j FROM papers) e
  JOIN papers q ON q.i = CASE WHEN e.j = 0 THEN e.i % (CAST(floor(e.n / 50) AS BIGINT) + 1)
                              ELSE (e.i * 7 + e.j * 13 + 1) % e.n END
),
edges AS (
  SELECT citing_id, pos, cited_title, {tid('cited_title')} AS cited_id, citing_i FROM refs
),
ded AS (
  SELECT id, doc_id, title, url, n_chars, n_merged FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_chars DESC, doc_id DESC) AS rn,
           count(*) OVER (PARTITION BY id) AS n_merged
    FROM papers) WHERE rn = 1
)"""


def with_graph(body: str) -> str:
    return "WITH " + PAPERS + "\n" + body


# expected parse of the rendered bibliography lines (see plans.fixtures.TEMPLATES): authors and style
_ACM = "'Niemi O.; Dahl R.'"
_ACM_COMMA = "'FERRO M.; NIEMI O.; DAHL R.'"
_CITATION_EXPECT = {
    "acm": (f"CASE WHEN pos % 2 = 0 THEN {_ACM} ELSE {_ACM_COMMA} END", "'acm'"),
    "noisy": ("'DAHL R.; NIEMI O.'", "'acm'"),
    "ieee": ("'O. Niemi; R. Dahl'", "'ieee'"),
    "springer": ("'Niemi O.; Dahl R.'", "'springer'"),
    "best": (
        f"CASE citing_i % 4 WHEN 0 THEN {_ACM} WHEN 1 THEN {_ACM_COMMA} WHEN 2 THEN 'O. Niemi; R. Dahl' ELSE 'Niemi O.; Dahl R.' END",
        "CASE citing_i % 4 WHEN 0 THEN 'acm' WHEN 1 THEN 'acm' WHEN 2 THEN 'ieee' ELSE 'springer' END",
    ),
}


def _citation_sql(style: str) -> str:
    authors, st = _CITATION_EXPECT[style]
    return with_graph(
        f"SELECT citing_id, pos, cited_title, cited_id, CAST(len(string_split(a, '; ')) AS INTEGER) AS n_authors, "
        f"a AS author_list, style FROM (SELECT *, {authors} AS a, {st} AS style FROM edges)"
    )


ORACLE = {
    "title_key": with_graph("SELECT doc_id, title, id FROM papers"),
    "title_key_dedup": with_graph("SELECT id, doc_id, title, n_merged FROM ded"),
    "extract_year": """
SELECT doc_id, CAST(coalesce(list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}'), lambda x: CAST(x AS INTEGER)),
                                         lambda y: y > 1990 AND y < 2013)[-1], 0) AS INTEGER) AS year
FROM documents""",
    "citation_acm": _citation_sql("acm"),
    "citation_noisy": _citation_sql("noisy"),
    "citation_ieee": _citation_sql("ieee"),
    "citation_springer": _citation_sql("springer"),
    "citation_best": _citation_sql("best"),
    "invert_citations": with_graph("""
SELECT d.id, d.doc_id, d.title, d.n_merged, coalesce(c.citations, 0) AS citations
FROM ded d LEFT JOIN (SELECT cited_id, count(*) AS citations FROM edges GROUP BY cited_id) c ON c.cited_id = d.id"""),
    "top_cited_50": with_graph("""
SELECT d.id, d.title, coalesce(c.n, 0) AS citations FROM ded d
LEFT JOIN (SELECT cited_id, count(*) AS n FROM edges GROUP BY 1) c ON c.cited_id = d.id
ORDER BY citations DESC, d.id LIMIT 50"""),
    "top_citing_50": with_graph("""
SELECT m.id, d.title, m.n_matches FROM (
  SELECT c.id, count(DISTINCT e.cited_id) AS n_matches
  FROM edges e JOIN ded c ON c.doc_id = e.citing_id
  WHERE e.cited_id IN (SELECT id FROM ded)
  GROUP BY c.id ORDER BY n_matches DESC, c.id ASC LIMIT 50) m JOIN ded d ON d.id = m.id"""),
}


# ------------------------------------------------------------------ captures
def captures_sql(length: str) -> str:
    """Capture rows from ``pages`` and their admission; ``length`` is the record
    length expression over (html, payload)."""
    return f"""
WITH caps AS (
  SELECT page_id,
         CASE WHEN page_id % 17 = 0 THEN NULL
              ELSE url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.ps' ELSE '' END END AS url,
         html,
         CASE WHEN page_id % 11 = 0 THEN html
              ELSE 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: application/pdf'
                   || chr(13) || chr(10) || chr(13) || chr(10) || html END AS payload
  FROM pages),
a AS (
  SELECT page_id, {length} AS length, CASE WHEN url = '' THEN NULL ELSE lower(url) END AS url,
         CASE WHEN url IS NULL OR url = '' THEN 'MissingUrl' WHEN {length} < 5000 THEN 'TooSmall' ELSE 'Admitted' END AS status,
         payload, instr(payload, chr(13) || chr(10) || chr(13) || chr(10)) AS pos
  FROM caps),
b AS (
  SELECT *, CASE WHEN status = 'Admitted' THEN
              CASE WHEN instr(url, '.pdf') > 0 THEN 'PDF' WHEN instr(url, '.ps') > 0 THEN 'PostScript' ELSE 'Unknown-PS' END
            END AS filetype,
         CAST(CASE WHEN pos > 0 THEN strlen(payload) - strlen(substr(payload, 1, pos - 1)) - 4 END AS INTEGER) AS body_len
  FROM a),
adm AS (
  SELECT page_id, length, url, status, filetype,
         CASE WHEN filetype IS NOT NULL THEN filetype ||
              CASE WHEN pos > 0 AND strlen(payload) >= 5000 AND body_len > 100 THEN '.success' ELSE '.failure' END
         END AS outcome, body_len
  FROM b)
"""


CAPTURES = captures_sql("length(html)")
ORACLE["capture_admission"] = CAPTURES + "SELECT page_id, url, status, filetype, outcome, body_len FROM adm"
# the archive record length is the payload's byte length
ORACLE["archive_states"] = "SELECT count(*) AS records, CAST(0 AS BIGINT) AS errors FROM pages"
ORACLE["ingest_documents"] = CAPTURES.replace("body_len\n  FROM b)", "body_len, payload, pos\n  FROM b)") + """
SELECT url, CAST(length(xml) AS INTEGER) AS xml_len, md5(xml) AS xml_md5 FROM (
  SELECT url, substr(payload, pos + 4) AS xml FROM adm WHERE ends_with(outcome, '.success'))"""
ORACLE["archive_records"] = captures_sql("strlen(payload)") + (
    "SELECT url, length, status, filetype, outcome, body_len FROM adm")
ORACLE["archive_members"] = ORACLE["archive_records"]
ORACLE["capture_status_counts"] = CAPTURES + "SELECT coalesce(outcome, status) AS status, count(*) AS n FROM adm GROUP BY 1"


# ------------------------------------------------------------------ layout over the node table
NODES = r"""
lines AS (
  SELECT doc_id, CAST(k AS BIGINT) AS i, ls[k + 1] AS line
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
),
nodes AS (
  SELECT doc_id, i, CAST(i // 40 AS INTEGER) + 1 AS page, i + 1 AS node_id,
         80 + 20 * CAST((i % 40) // 2 AS INTEGER) AS top, 100 + 320 * CAST(i % 2 AS INTEGER) AS lft,
         CAST(least(8 * length(line), 300) AS INTEGER) AS width,
         CASE WHEN i = 0 THEN 20 ELSE 12 END AS height,
         CASE WHEN i = 0 THEN 34 ELSE 10 END AS font_size,
         CASE WHEN i % 5 = 3 THEN line || '-' ELSE line END AS text
  FROM lines
)"""

LAYOUT_TEXT = r"""
t AS (
  SELECT doc_id, node_id, text, lft, width, top,
         coalesce(lag(lft) OVER w, lft) AS pl, coalesce(lag(width) OVER w, width) AS pw,
         coalesce(lag(top) OVER w, top) AS pt, coalesce(lag(text) OVER w, text) AS ptx,
         max(lft + width) OVER (PARTITION BY doc_id) AS maxr
  FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_id)),
p AS (
  SELECT doc_id, node_id,
         CASE WHEN abs(top - pt) > 2 AND maxr > 50 AND NOT ends_with(ptx, '-') THEN chr(10) || text
              WHEN abs(lft - (pl + pw)) > 2 AND NOT ends_with(ptx, '-') THEN ' ' || text
              ELSE text END AS piece
  FROM t),
doc_text AS (
  SELECT doc_id, string_agg(CASE WHEN ends_with(piece, '-') THEN substr(piece, 1, length(piece) - 1) ELSE piece END,
                            '' ORDER BY node_id) AS text
  FROM p GROUP BY doc_id)"""

LAYOUT_TITLE = r"""
pg AS (
  SELECT doc_id, node_id, top, height, text,
         CASE WHEN text = '' OR NOT regexp_matches(substr(text, 1, 1), '^\p{Lu}') THEN 0.0
              ELSE font_size / (ln(10 + abs(100 - top)) * ln(10 + abs(400 - (lft + width // 2)))) END AS score
  FROM nodes WHERE page = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id DESC) AS r FROM pg),
cand AS (
  SELECT c.doc_id, c.r, c.node_id AS cid, c.height AS ch, l.top AS ltop, l.height AS lh
  FROM rk c JOIN rk l ON l.doc_id = c.doc_id AND l.r = 1 WHERE c.r <= 5),
fail AS (
  SELECT c.doc_id, c.r, min(m.node_id) AS end_id
  FROM cand c JOIN pg m ON m.doc_id = c.doc_id
  WHERE m.node_id >= c.cid + CASE WHEN c.r = 1 THEN 1 ELSE 0 END
    AND NOT (abs(m.height - c.ch) < 2 AND (m.top = c.ltop OR abs(m.top - c.ltop - c.lh) < 20))
  GROUP BY c.doc_id, c.r),
runs AS (
  SELECT c.doc_id, c.r,
         coalesce(string_agg(regexp_replace(m.text, '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g'), ' ' ORDER BY m.node_id), '') AS title
  FROM cand c LEFT JOIN fail f ON f.doc_id = c.doc_id AND f.r = c.r
  LEFT JOIN pg m ON m.doc_id = c.doc_id AND m.node_id >= c.cid AND (f.end_id IS NULL OR m.node_id < f.end_id)
  GROUP BY c.doc_id, c.r),
best AS (
  SELECT doc_id, title FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS q FROM runs
    WHERE length(title) > 10 AND length(title) < 150) WHERE q = 1),
doc_title AS (SELECT d.doc_id, coalesce(b.title, '') AS title FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id)"""

XML_LEN = r"""
xml_len AS (
  SELECT doc_id,
         strlen('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">' || chr(10)
                || '<pdf2xml>' || chr(10) || '<fontspec id="0" size="10" family="Times"/>' || chr(10)
                || '<fontspec id="1" size="17" family="Times"/>' || chr(10) || '</page>' || chr(10) || '</pdf2xml>' || chr(10))
         + sum(strlen(
             CASE WHEN i % 40 = 0 THEN CASE WHEN i > 0 THEN '</page>' || chr(10) ELSE '' END
                                       || '<page number="' || CAST(i // 40 + 1 AS VARCHAR) || '">' || chr(10) ELSE '' END
             || '<text top="' || CAST(80 + 20 * ((i % 40) // 2) AS VARCHAR) || '" left="' || CAST(100 + 320 * (i % 2) AS VARCHAR)
             || '" width="' || CAST(least(8 * length(line), 300) AS VARCHAR)
             || '" height="' || CASE WHEN i = 0 THEN '20' ELSE '12' END || '" font="' || CASE WHEN i = 0 THEN '1' ELSE '0' END || '">'
             || CASE WHEN i = 0 THEN '<b>' ELSE '' END
             || replace(replace(replace(CASE WHEN i % 5 = 3 THEN line || '-' ELSE line END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
             || CASE WHEN i = 0 THEN '</b>' ELSE '' END || '</text>' || chr(10))) AS n
  FROM lines GROUP BY doc_id)"""

ORACLE["layout_text"] = "WITH " + NODES + "," + LAYOUT_TEXT + "\nSELECT doc_id, text FROM doc_text"
ORACLE["layout_title"] = "WITH " + NODES + "," + LAYOUT_TITLE + "\nSELECT doc_id, title FROM doc_title"
ORACLE["title_gate_counts"] = "WITH " + NODES + "," + LAYOUT_TITLE + "," + XML_LEN + """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN title = '' THEN 'NoTitle' WHEN length(title) < 5 THEN 'ShortTitle' ELSE 'GoodTitle' END AS status
  FROM doc_title) GROUP BY status
UNION ALL SELECT 'TooLong', count(*) FROM xml_len WHERE n > 10000000"""



# ------------------------------------------------------------------ graph extras
def ctes(*parts: str) -> str:
    """More CTEs after the fixture CTEs."""
    return "," + ",".join(parts)


ORACLE["citation_histogram"] = with_graph(ctes(
    """opd AS (SELECT coalesce(c.v, 0) AS v FROM papers p
          LEFT JOIN (SELECT citing_id, count(*) AS v FROM edges GROUP BY 1) c ON c.citing_id = p.doc_id)""",
    "cites AS (SELECT cited_id AS key, count(*) AS cites FROM edges GROUP BY 1)",
    "dk AS (SELECT id AS key, count(*) AS docs FROM papers GROUP BY 1)",
    """pk AS (SELECT coalesce(c.cites, 0) AS cites, coalesce(d.docs, 0) AS docs
          FROM cites c FULL OUTER JOIN dk d ON c.key = d.key)""",
) + """
SELECT 'map-citations' AS metric, CAST(floor(ln(1 + v) / ln(1.1)) AS INTEGER) AS bucket, count(*) AS n FROM opd GROUP BY 2
UNION ALL SELECT 'citation.count', CAST(floor(ln(1 + cites) / ln(1.1)) AS INTEGER), count(*) FROM pk GROUP BY 2
UNION ALL SELECT 'doc.count', CAST(floor(ln(1 + docs) / ln(1.1)) AS INTEGER), count(*) FROM pk GROUP BY 2""")

INVERTED = """inv AS (
  SELECT d.id, d.doc_id, d.title, d.n_merged, coalesce(c.citations, 0) AS citations
  FROM ded d LEFT JOIN (SELECT cited_id, count(*) AS citations FROM edges GROUP BY cited_id) c ON c.cited_id = d.id)"""

ORACLE["test_set"] = with_graph(ctes(INVERTED) + """
SELECT id, doc_id, title, citations FROM inv WHERE citations BETWEEN 20 AND 100""")

ORACLE["matches_in_corpus"] = with_graph("""
SELECT DISTINCT citing_id, cited_id FROM edges WHERE cited_id IN (SELECT id FROM ded)""")

ORACLE["dangling_references"] = with_graph(ctes("""extra AS (
  SELECT p.doc_id AS citing_id, t.cited_title
  FROM (SELECT doc_id AS x_id, trim(regexp_replace(split_part(text, chr(10), 1), '[.?()\\s]+', ' ', 'g')) AS cited_title
        FROM documents) t
  JOIN papers p ON p.i = t.x_id % p.n
  WHERE length(t.cited_title) >= 150)""") + f"""
SELECT citing_id, cited_title, {tid('cited_title')} AS cited_id FROM extra
WHERE {tid('cited_title')} NOT IN (SELECT id FROM ded)""")

_DANGLING = ORACLE["dangling_references"].split("\nSELECT citing_id, cited_title")[0]
ORACLE["test_set_counts"] = _DANGLING + f""",
every AS (SELECT cited_id FROM edges UNION ALL SELECT {tid('cited_title')} FROM extra),
n AS (SELECT cited_id, count(*) AS n FROM every GROUP BY 1)
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN coalesce(n.n, 0) < 20 THEN 'Too Few Citations' WHEN n.n > 100 THEN 'Too Many Citations' ELSE 'Selected' END AS status
  FROM ded d LEFT JOIN n ON n.cited_id = d.id
  UNION ALL SELECT 'Missing Document' FROM n WHERE cited_id NOT IN (SELECT id FROM ded)) GROUP BY status"""

ORACLE["lookup_titles"] = with_graph(f"""
SELECT e.cited_title, t.doc_id, {tid('t.title')} AS id
FROM (SELECT DISTINCT cited_title FROM edges) e
JOIN (SELECT title, max(doc_id) AS doc_id FROM papers GROUP BY title) t ON t.title = e.cited_title""")

ORACLE["lookup_ids"] = with_graph("""
SELECT r.shard, d.id, d.doc_id, d.title
FROM (SELECT DISTINCT CAST(((cited_id % 100) + 100) % 100 AS INTEGER) AS shard, cited_id AS id FROM edges) r
JOIN ded d ON d.id = r.id""")

DENSE = """idx AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS UBIGINT) AS i,
                    CAST(count(*) OVER () AS UBIGINT) AS n FROM ded)"""

ORACLE["random_doc"] = with_graph(ctes(DENSE) + """
SELECT d.id, d.doc_id, d.title FROM idx JOIN ded d ON d.id = idx.id
WHERE idx.i = CAST('0x' || substr(md5('random:0'), 1, 15) AS UBIGINT) % idx.n""")


# ------------------------------------------------------------------ term weights
def bow(name: str, source: str, key: str) -> str:
    """Tokenizer A as SQL: lower-case, strip trailing delimiters, split on each delimiter."""
    d = "'[0-9\\t\\n\\x0B\\f\\r [:punct:]]'"
    dt = "'[0-9\\t\\n\\x0B\\f\\r [:punct:]]+$'"
    return f"""{name}_tok AS (
  SELECT {key}, CASE WHEN low <> '' AND st = '' THEN []::VARCHAR[] ELSE string_split_regex(st, {d}) END AS ts
  FROM (SELECT {key}, lower(text) AS low, regexp_replace(lower(text), {dt}, '') AS st FROM {source})),
{name} AS (
  SELECT {key}, term, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT {key}, unnest(ts) AS term FROM {name}_tok)
  GROUP BY {key}, term)"""


DOC_BOW = "WITH " + bow("dbow", "documents", "doc_id") + """,
didf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM dbow GROUP BY term)"""

ORACLE["bag_of_words"] = DOC_BOW + "\nSELECT doc_id, term, cnt FROM dbow"
ORACLE["idf"] = DOC_BOW + "\nSELECT term, df, round(idf, 6) AS idf FROM didf"
ORACLE["tfidf"] = DOC_BOW + "\nSELECT b.doc_id, b.term, round(b.cnt * i.idf, 6) AS weight FROM dbow b JOIN didf i ON i.term = b.term"


# ------------------------------------------------------------------ evaluation
def ranked(name: str, weights: str) -> str:
    return f"""{name} AS (
  SELECT focus_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY focus_id ORDER BY round(score, 9) DESC NULLS LAST, id) AS rank FROM (
      SELECT f.id AS focus_id, u.id,
             coalesce(x.score, CASE WHEN u.id IN (SELECT id FROM {weights}) THEN 0.0 ELSE 'NaN'::DOUBLE END) AS score
      FROM focus f CROSS JOIN (SELECT id FROM ded) u
      LEFT JOIN (
        SELECT d.focus_id, d.id, CASE WHEN s.wsum = 0 THEN NULL ELSE d.dot / s.wsum END AS score
        FROM (SELECT f.id AS focus_id, c.id, sum(f.weight * c.weight) AS dot
              FROM {weights} f JOIN {weights} c ON c.term = f.term
              WHERE f.id IN (SELECT id FROM focus) GROUP BY 1, 2) d
        JOIN (SELECT id, sum(weight) AS wsum FROM {weights} GROUP BY id) s ON s.id = d.id) x
      ON x.focus_id = f.id AND x.id = u.id))
  WHERE rank <= 1000)"""


EVAL = with_graph(ctes(
    """pairs AS (SELECT DISTINCT c.id AS citing_key, e.cited_id FROM edges e JOIN ded c ON c.doc_id = e.citing_id
             WHERE e.cited_id IN (SELECT id FROM ded))""",
    """focus AS (SELECT citing_key AS id FROM (SELECT citing_key, count(*) AS n_matches FROM pairs GROUP BY 1
                                             ORDER BY n_matches DESC, citing_key ASC LIMIT 50))""",
    """real AS (SELECT citing_key AS focus_id, cited_id AS id,
                    row_number() OVER (PARTITION BY citing_key ORDER BY cited_id) AS rrank
             FROM pairs WHERE citing_key IN (SELECT id FROM focus))""",
    "corpus AS (SELECT d.id, p.text FROM ded d JOIN papers p ON p.doc_id = d.doc_id)",
    bow("cbow", "corpus", "id"),
    "cidf AS (SELECT term, ln((SELECT count(*) FROM corpus) / count(*)) AS idf FROM cbow GROUP BY term)",
    """wts AS (SELECT b.id, b.term, b.cnt * i.idf AS weight FROM cbow b JOIN cidf i ON i.term = b.term
            WHERE b.cnt * i.idf <> 0)""",
    "cnts AS (SELECT id, term, cnt AS weight FROM cbow)",
    ranked("r_overlap", "cnts"),
    ranked("r_tfidf", "wts"),
))


def curve(metric: str, rk: str) -> str:
    return f"""
SELECT '{metric}' AS metric, ns.n,
  (SELECT count(*) FROM real r JOIN {rk} k ON k.focus_id = r.focus_id AND k.id = r.id
   WHERE greatest(r.rrank, k.rank) <= ns.n) AS matched,
  (SELECT count(*) FROM real r WHERE r.rrank <= ns.n) AS found
FROM (SELECT CAST(range AS INTEGER) AS n FROM range(10, 100)) ns"""


ORACLE["similar_overlap"] = EVAL + "\nSELECT focus_id, id, round(score, 6) AS score, rank FROM r_overlap"
ORACLE["similar_tfidf"] = EVAL + "\nSELECT focus_id, id, round(score, 6) AS score, rank FROM r_tfidf"
ORACLE["similar_all"] = with_graph(ctes(
    "corpus AS (SELECT d.id, p.text FROM ded d JOIN papers p ON p.doc_id = d.doc_id)",
    bow("cbow", "corpus", "id"),
    "cidf AS (SELECT term, ln((SELECT count(*) FROM corpus) / count(*)) AS idf FROM cbow GROUP BY term)",
    "wts AS MATERIALIZED (SELECT b.id, b.term, b.cnt * i.idf AS weight FROM cbow b JOIN cidf i ON i.term = b.term WHERE b.cnt * i.idf <> 0)",
    "dots AS (SELECT f.id, c.id AS other, sum(f.weight * c.weight) AS dot FROM wts f JOIN wts c ON c.term = f.term GROUP BY 1, 2)",
    "sums AS (SELECT id, sum(weight) AS total FROM wts GROUP BY 1)",
)) + """
SELECT id, other, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS rank
  FROM (SELECT d.id, d.other, d.dot / s.total AS score FROM dots d JOIN sums s ON s.id = d.other)) WHERE rank <= 10"""
ORACLE["recall_curve"] = EVAL + curve("overlap", "r_overlap") + "\nUNION ALL" + curve("tfidf", "r_tfidf")
ORACLE["evaluation_report"] = EVAL + """
SELECT f.id, d.title, CAST(coalesce(a.matched, 0) AS BIGINT) AS matched, coalesce(a.found, 0) AS found,
       coalesce(t.total, 0) AS total,
       round(CASE WHEN coalesce(a.found, 0) = 0 THEN NULL
                  ELSE 100.0 * CAST(coalesce(a.matched, 0) AS DOUBLE) / a.found END, 6) AS percent
FROM focus f JOIN ded d ON d.id = f.id
LEFT JOIN (SELECT r.focus_id, sum(CASE WHEN k.rank <= 100 THEN 1 ELSE 0 END) AS matched, count(*) AS found
           FROM real r LEFT JOIN r_tfidf k ON k.focus_id = r.focus_id AND k.id = r.id
           WHERE r.rrank <= 100 GROUP BY 1) a ON a.focus_id = f.id
LEFT JOIN (SELECT c.id, count(*) AS total FROM edges e JOIN ded c ON c.doc_id = e.citing_id GROUP BY 1) t ON t.id = f.id"""


# ------------------------------------------------------------------ learning
LEARN = with_graph(ctes(
    DENSE,
    """pos AS (SELECT e.cited_id AS id, p.id AS positive_id, count(*) AS mult
            FROM edges e JOIN ded d ON d.id = e.cited_id
            JOIN (SELECT title, arg_max(id, doc_id) AS id FROM ded GROUP BY title) p ON p.title = e.cited_title
            GROUP BY 1, 2)""",
    """neg AS (SELECT d.id, CAST(d.j AS INTEGER) AS draw, x.id AS sampled_id
            FROM (SELECT id, n, unnest(range(50)) AS j FROM idx) d
            JOIN idx x ON x.i = CAST('0x' || substr(md5(CAST(d.id AS VARCHAR) || ':' || CAST(d.j AS VARCHAR) || ':0'), 1, 15)
                                     AS UBIGINT) % d.n)""",
))

ORACLE["nb_positives"] = LEARN + "\nSELECT id, positive_id, mult FROM pos"
ORACLE["nb_negatives"] = LEARN + "\nSELECT id, draw, sampled_id FROM neg"
def stored_once(sql: str) -> str:
    """Every CTE that others share is computed once, however often it is read."""
    return re.sub(r"(?m)^( *|WITH |,)(papers|refs|edges|ded|idx|pos|neg|w|g|c|fold) AS \(", r"\1\2 AS MATERIALIZED (", sql)


def _nb(training: str) -> str:
    return LEARN + ctes(
        f"""
mult AS (SELECT * FROM (SELECT positive_id AS doc, 'good-cite' AS label, sum(mult) AS mult FROM pos GROUP BY 1
             UNION ALL SELECT sampled_id, 'bad-cite', count(*) FROM neg GROUP BY 1){training})""",
        "texts AS (SELECT d.id, p.text FROM ded d JOIN papers p ON p.doc_id = d.doc_id)",
        f"""
w AS (SELECT m.label, m.mult, regexp_extract_all(t.text, '{_NB_WORD}') AS ws
          FROM mult m JOIN texts t ON t.id = m.doc)""",
        """
g AS (SELECT label, mult, unnest(ws) AS ngram FROM w
          UNION ALL SELECT label, mult, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) FROM w)""",
        """
c AS (SELECT label, ngram, CAST(sum(mult) AS DOUBLE) AS cnt FROM g GROUP BY 1, 2)""",
        "tot AS (SELECT sum(cnt) AS total FROM c)",
    )


_NB_WORD = "[\\p{L}\\p{N}]+(?:[''’.][\\p{L}\\p{N}]+)*"
_FOLD = "CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 15) AS UBIGINT) % 5"
ORACLE["nb_model"] = stored_once(_nb("") + "\nSELECT label, ngram, cnt, total, cnt / total AS weight FROM c, tot WHERE cnt > 1")
ORACLE["learned_naive_bayes"] = ORACLE["nb_model"]
ORACLE["learned_lengths"] = LEARN + ctes(
    "mult AS (SELECT positive_id AS doc, 'good-cite' AS label, sum(mult) AS mult FROM pos GROUP BY 1 UNION ALL SELECT sampled_id, 'bad-cite', count(*) FROM neg GROUP BY 1)",
    "x AS (SELECT m.label, m.mult, CAST(length(p.text) AS HUGEINT) AS size FROM mult m JOIN ded d ON d.id = m.doc JOIN papers p ON p.doc_id = d.doc_id)",
) + """
SELECT label, CAST(sum(mult) AS BIGINT) AS n, round(sum(mult * size) / sum(mult), 6) AS mean,
       round(sum(mult * size * size) / sum(mult) - (sum(mult * size) / sum(mult)) * (sum(mult * size) / sum(mult)), 6) AS variance
FROM x GROUP BY label"""
ORACLE["nb_score"] = stored_once(_nb(" WHERE " + _FOLD.format(x="doc") + " <> 0") + ctes(
    "m AS (SELECT ngram, coalesce(sum(cnt) FILTER (WHERE label = 'good-cite'), 0) AS good, coalesce(sum(cnt) FILTER (WHERE label = 'bad-cite'), 0) AS bad FROM c WHERE cnt > 1 GROUP BY 1)",
    "s AS (SELECT ln(sum(bad) + count(*) + 1) - ln(sum(good) + count(*) + 1) AS unseen FROM m)",
    f"hw AS (SELECT id, regexp_extract_all(text, '{_NB_WORD}') AS ws FROM texts WHERE " + _FOLD.format(x="id") + " = 0)",
    "hg AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS ngram FROM hw)",
    "k AS (SELECT id, count(*) AS n, sum(ln(good + 1) - ln(bad + 1)) AS known FROM hg JOIN m USING (ngram) GROUP BY 1)",
) + """
SELECT hw.id, CAST(len(ws) + greatest(len(ws) - 1, 0) AS BIGINT) AS n_ngrams, coalesce(k.n, 0) AS n_known,
       round((len(ws) + greatest(len(ws) - 1, 0)) * s.unseen + coalesce(k.known, 0), 6) AS log_odds
FROM hw CROSS JOIN s LEFT JOIN k ON k.id = hw.id""")


# ------------------------------------------------------------------ index and search
_WORD = "[\\p{L}\\p{N}]+(?:[''’.][\\p{L}\\p{N}]+)*"


def _stops() -> str:
    from citegraph.functions.constants import ENGLISH_STOP_WORDS

    return ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def gapped(expr: str) -> str:
    """Lower-case words with stop words as NULL gaps."""
    return (f"list_transform(regexp_extract_all(lower({expr}), '{_WORD}'), "
            f"lambda x: CASE WHEN x IN ({_stops()}) THEN NULL ELSE x END)")


def win(w: str, n: int) -> str:
    """Gap-free n-word windows of list ``w``."""
    return (f"list_transform(list_filter(range(1, len({w}) - {n} + 2), lambda i: list_count({w}[i:i + {n} - 1]) = {n}), "
            f"lambda i: array_to_string({w}[i:i + {n} - 1], ' '))")


def all_terms(w: str) -> str:
    uni = f"list_filter({w}, lambda x: x IS NOT NULL)"
    return f"list_concat({uni}, list_concat({win(w, 2)}, list_concat({win(w, 3)}, {win(w, 4)})))"


INDEX = with_graph(ctes(
    INVERTED,
    "idocs AS (SELECT i.id, p.text, i.title, i.citations FROM inv i JOIN papers p ON p.doc_id = i.doc_id)",
    f"""gw AS (SELECT id, 'text' AS field, {gapped('text')} AS w FROM idocs
           UNION ALL SELECT id, 'title' AS field, {gapped('title')} AS w FROM idocs)""",
    f"tw AS (SELECT id, field, CAST(len(list_filter(w, lambda x: x IS NOT NULL)) AS INTEGER) AS field_len, {all_terms('w')} AS ts FROM gw)",
    """post AS (SELECT field, term, id, CAST(((id % 100) + 100) % 100 AS INTEGER) AS shard, count(*) AS tf, field_len
             FROM (SELECT id, field, field_len, unnest(ts) AS term FROM tw) GROUP BY field, term, id, field_len)""",
    "q AS (SELECT item_id AS query_id, 'text' AS field, trim(text) AS text FROM benchmark)",
))


def length_norm_sql(length: str) -> str:
    return f"(1.0 / sqrt(CAST({length} AS DOUBLE)))"


def scores(qtable: str, per_shard: bool) -> str:
    sh = ", shard" if per_shard else ""
    return ctes(
        f"qw AS (SELECT query_id, field, {gapped('text')} AS w FROM {qtable})",
        "qt AS (SELECT DISTINCT query_id, field, unnest(list_filter(w, lambda x: x IS NOT NULL)) AS term FROM qw)",
        "nq AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY 1)",
        f"dfs AS (SELECT field, term{sh}, count(*) AS df FROM post GROUP BY field, term{sh})",
        f"""nn AS (SELECT {'shard, ' if per_shard else ''}count(*) AS n
               FROM (SELECT CAST(((id % 100) + 100) % 100 AS INTEGER) AS shard FROM idocs){' GROUP BY shard' if per_shard else ''})""",
        f"""hits AS (SELECT q.query_id, q.term, p.id, p.shard, p.tf, p.field_len, {length_norm_sql('p.field_len')} AS fnorm,
                        1.0 + ln(CAST(nn.n AS DOUBLE) / (CAST(d.df AS DOUBLE) + 1.0)) AS idf
                 FROM qt q JOIN post p ON p.field = q.field AND p.term = q.term
                 JOIN dfs d ON d.field = q.field AND d.term = q.term{' AND d.shard = p.shard' if per_shard else ''}
                 JOIN nn ON {'nn.shard = p.shard' if per_shard else 'true'})""",
        f"""qn AS (SELECT q.query_id{', s.shard' if per_shard else ''},
                      1.0 / sqrt(coalesce(sum(x.idf2), 0.0) + (nq.nq - count(x.term)) * (1.0 + ln(CAST(s.n AS DOUBLE))) * (1.0 + ln(CAST(s.n AS DOUBLE)))) AS qnorm
               FROM nq q JOIN nq ON nq.query_id = q.query_id
               JOIN nn s ON {'true' if not per_shard else 'true'}
               LEFT JOIN (SELECT DISTINCT query_id{', shard' if per_shard else ''}, term, idf * idf AS idf2 FROM hits) x
                 ON x.query_id = q.query_id{' AND x.shard = s.shard' if per_shard else ''}
               GROUP BY q.query_id{', s.shard' if per_shard else ''}, nq.nq, s.n)""",
        f"""ts AS (SELECT h.query_id, h.id, h.shard,
                      sum(sqrt(h.tf) * h.idf * h.idf * h.fnorm) * count(*) / nq.nq * qn.qnorm AS text_score,
                      count(*) AS matched
               FROM hits h JOIN nq ON nq.query_id = h.query_id
               JOIN qn ON qn.query_id = h.query_id{' AND qn.shard = h.shard' if per_shard else ''}
               GROUP BY h.query_id, h.id, h.shard, nq.nq, qn.qnorm)""",
    )


def ranked_results(ts: str, part: str, n_cand: int, n_keep: int, scorer: str, shard_col: bool) -> str:
    return f"""
SELECT query_id{', shard, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS merged_rank' if shard_col else ''}, CAST(rank AS INTEGER) AS rank, id, title, citations,
       round(text_score, 6) AS text_score, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, id) AS rank
      FROM (SELECT c.query_id, c.shard, c.id, i.title, i.citations, c.text_score, {scorer} AS score
            FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(text_score, 9) DESC, id) AS cr
                                 FROM {ts}) WHERE cr <= {n_cand}) c
            JOIN idocs i ON i.id = c.id))
WHERE rank <= {n_keep}"""


def PHRASES(qtable: str, cond: str) -> str:
    """CTEs phr (phrase queries with a word) and phm (documents that hold the phrase): token sequences compared
    place by place, a removed stop word standing for any word."""
    return f"""phr AS (SELECT query_id, field, w FROM (SELECT query_id, field, {gapped('text')} AS w FROM {qtable} WHERE {cond}) WHERE list_count(w) > 0),
  phw AS (SELECT query_id, field, w, list_filter(w, lambda x: x IS NOT NULL)[1] AS lead FROM phr),
  phm AS (SELECT DISTINCT q.query_id, d.id FROM phw q
          JOIN (SELECT id, field, w AS dw, unnest(list_distinct(list_filter(w, lambda x: x IS NOT NULL))) AS term FROM gw) d ON d.field = q.field AND d.term = q.lead
          WHERE len(list_filter(range(1, len(d.dw) + 1), lambda i:
                len(list_filter(range(0, len(q.w)), lambda j: q.w[j + 1] IS NOT NULL AND (d.dw[i + j] IS NULL OR d.dw[i + j] <> q.w[j + 1]))) = 0)) > 0)"""


_REFS_SCORER = "c.text_score * CAST(i.citations AS DOUBLE)"

ORACLE["index_postings"] = INDEX + "\nSELECT field, term, id, shard, tf, field_len FROM post"
ORACLE["search_text"] = INDEX + scores("q", False) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(text_score, 6) AS text_score, matched FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, id) AS rank FROM ts)
WHERE rank <= 100"""
ORACLE["search_scored"] = INDEX + scores("q", False) + ranked_results("ts", "query_id", 10**9, 10, _REFS_SCORER, False)
ORACLE["search_sharded"] = INDEX + scores("q", True) + ranked_results(
    "ts", "query_id, shard", 100, 5, _REFS_SCORER, True)
ORACLE["search_fielded"] = INDEX + ctes(
    f"""fq AS (SELECT query_id, text, CASE WHEN query_id % 2 = 0 THEN 'text' ELSE 'title' END AS field,
                   list_filter({gapped('text')}, lambda x: x IS NOT NULL) AS nw, query_id % 3 = 0 AS phrase FROM q)""",
) + scores("fq", False) + ctes(
    "req AS (SELECT DISTINCT query_id, field, nw[1] AS term FROM fq WHERE len(nw) > 0)",
    """musts AS (SELECT r.query_id, p.id FROM req r JOIN post p ON p.field = r.field AND p.term = r.term)""",
    PHRASES("fq", "phrase"),
    """exc AS (SELECT DISTINCT f.query_id, p.id FROM fq f JOIN post p ON p.field = f.field AND p.term = f.nw[len(f.nw)]
             WHERE len(f.nw) > 1)""",
    """tsf AS (SELECT t.* FROM ts t
             WHERE (t.query_id NOT IN (SELECT query_id FROM req)
                    OR EXISTS (SELECT 1 FROM musts s WHERE s.query_id = t.query_id AND s.id = t.id))
               AND (t.query_id NOT IN (SELECT query_id FROM phr)
                    OR EXISTS (SELECT 1 FROM phm s WHERE s.query_id = t.query_id AND s.id = t.id))
               AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.query_id = t.query_id AND e.id = t.id))""",
) + ranked_results("tsf", "query_id", 10**9, 10, "c.text_score", False)


ORACLE["search_stored"] = ORACLE["search_scored"]
ORACLE["index_positions"] = INDEX + """
SELECT field, term, id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM (SELECT id, field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM gw) WHERE term IS NOT NULL GROUP BY 1, 2, 3"""
ORACLE["search_phrase"] = INDEX + ctes(
    f"""pq AS (SELECT doc_id AS query_id, 'text' AS field, array_to_string(w[3:2 + CAST(2 + (doc_id // 20) % 7 AS INTEGER)], ' ') AS text
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE doc_id % 20 = 0))""",
) + scores("pq", False) + ctes(PHRASES("pq", "true")) + """
SELECT query_id, id, round(text_score, 6) AS text_score, matched FROM ts t
WHERE t.query_id NOT IN (SELECT query_id FROM phr) OR EXISTS (SELECT 1 FROM phm s WHERE s.query_id = t.query_id AND s.id = t.id)"""


# ------------------------------------------------------------------ extract job over text + bibliography
def _nodes_from(source: str) -> str:
    """The NODES CTEs over an arbitrary (doc_id, text) relation."""
    return NODES.replace("FROM documents))", f"FROM {source}))")


_BIB_LINE = ("CASE WHEN pos % 2 = 0 THEN 'O. Niemi and R. Dahl. ' || cited_title || '. Harbour Notes, 2006.' "
             "ELSE 'NIEMI, O., DAHL, R., AND FERRO, M. ' || cited_title || '. Harbour Notes, 2006.' END")

_EXTRACT = ctes(
    f"bibs AS (SELECT citing_id AS doc_id, string_agg({_BIB_LINE}, chr(10) ORDER BY pos) AS bib FROM edges GROUP BY 1)",
    "xdocs AS (SELECT p.doc_id, translate(p.text, '.', ';') || chr(10) || b.bib AS text FROM papers p JOIN bibs b ON b.doc_id = p.doc_id)",
    _nodes_from("xdocs").strip(),
    LAYOUT_TEXT.strip(),
    LAYOUT_TITLE.strip().replace("FROM documents d LEFT JOIN best b", "FROM xdocs d LEFT JOIN best b"),
)
ORACLE["extract_documents"] = with_graph(_EXTRACT + f"""
SELECT t.doc_id,
       CASE WHEN t.title = '' THEN 'NoTitle' WHEN length(t.title) < 5 THEN 'ShortTitle' ELSE 'GoodTitle' END AS status,
       t.title, {tid('t.title')} AS id,
       CAST(coalesce(list_filter(list_transform(regexp_extract_all(dt.text, '[0-9]{{4}}'), lambda v: CAST(v AS INTEGER)),
                                 lambda y: y > 1990 AND y < 2013)[-1], 0) AS INTEGER) AS year
FROM doc_title t JOIN doc_text dt ON dt.doc_id = t.doc_id""")


ORACLE["extract_edges"] = with_graph(_EXTRACT + """
SELECT e.citing_id, e.pos, e.cited_title, e.cited_id, CAST(CASE WHEN e.pos % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_authors
FROM edges e JOIN doc_title t ON t.doc_id = e.citing_id WHERE length(t.title) >= 5""")

ORACLE["pipeline_records"] = with_graph(_EXTRACT + f""",
good AS (SELECT t.doc_id, t.title, {tid('t.title')} AS id FROM doc_title t WHERE length(t.title) >= 5),
sized AS (SELECT g.*, x.n AS size FROM good g JOIN xml_chars x ON x.doc_id = g.doc_id),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, doc_id DESC) AS rn, count(*) OVER (PARTITION BY id) AS n_merged FROM sized) WHERE rn = 1),
cites AS (SELECT e.cited_id, count(*) AS n FROM edges e JOIN good g ON g.doc_id = e.citing_id GROUP BY 1)
SELECT m.id, m.doc_id, m.title, m.n_merged, coalesce(c.n, 0) AS citations,
       CAST((SELECT count(*) FROM edges e WHERE e.citing_id = m.doc_id) AS INTEGER) AS n_outgoing, coalesce(c.n, 0) AS n_listed
FROM merged m LEFT JOIN cites c ON c.cited_id = m.id""").replace("sized AS (", XML_LEN.strip().replace("xml_len AS", "xml_chars AS").replace("strlen(", "length(") + ",\nsized AS (", 1)


ORACLE["pipeline_counters"] = with_graph(_EXTRACT + """,
good AS (SELECT t.doc_id FROM doc_title t WHERE length(t.title) >= 5)
SELECT 'GoodTitle' AS counter, (SELECT count(*) FROM good) AS n
UNION ALL SELECT 'ShortTitle', (SELECT count(*) FROM doc_title WHERE title <> '' AND length(title) < 5)
UNION ALL SELECT 'NoTitle', (SELECT count(*) FROM doc_title WHERE title = '')
UNION ALL SELECT 'TooLong', (SELECT count(*) FROM xml_sizes WHERE n > 10000000)
UNION ALL SELECT 'citations', (SELECT count(*) FROM edges e JOIN good g ON g.doc_id = e.citing_id)
UNION ALL SELECT 'citing', (SELECT count(DISTINCT e.citing_id) FROM edges e JOIN good g ON g.doc_id = e.citing_id)""").replace("good AS (", XML_LEN.strip().replace("xml_len AS", "xml_sizes AS") + ",\ngood AS (", 1)
ORACLE["streamed_inversion"] = ORACLE["pipeline_records"].replace("coalesce(c.n, 0) AS citations,", "coalesce(c.n, 0) AS citations", 1).replace(
    "       CAST((SELECT count(*) FROM edges e WHERE e.citing_id = m.doc_id) AS INTEGER) AS n_outgoing, coalesce(c.n, 0) AS n_listed\n", "", 1)

# every third document again with one more page, every fifth again unchanged: the copies' citations count, their keys do not
ORACLE["recrawled_records"] = with_graph(_EXTRACT + f""",
good AS (SELECT t.doc_id, t.title, {tid('t.title')} AS id FROM doc_title t WHERE length(t.title) >= 5),
caps AS (SELECT g.*, x.n + CASE WHEN k = 1 THEN {len(LAST_PAGE) - len("</pdf2xml>")} ELSE 0 END AS size, k
         FROM good g JOIN xml_chars x ON x.doc_id = g.doc_id, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR (k = 1 AND g.doc_id % 3 = 0) OR (k = 2 AND g.doc_id % 5 = 0)),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, doc_id DESC) AS rn, count(*) OVER (PARTITION BY id) AS n_merged FROM caps) WHERE rn = 1),
cites AS (SELECT e.cited_id, count(*) AS n FROM edges e JOIN caps g ON g.doc_id = e.citing_id GROUP BY 1)
SELECT m.id, m.doc_id, m.title, m.n_merged, coalesce(c.n, 0) AS citations, m.k = 1 AS longest
FROM merged m LEFT JOIN cites c ON c.cited_id = m.id""").replace("caps AS (", XML_LEN.strip().replace("xml_len AS", "xml_chars AS").replace("strlen(", "length(") + ",\ncaps AS (", 1)


# the final contents of the epochs, inverted from scratch (references are numbered anew in each bibliography)
ORACLE["incremental_inversion"] = with_graph(f""",
kept AS (SELECT citing_id, pos, cited_title FROM refs WHERE citing_id % 3 <> 1 OR (citing_id % 5 <> 0 AND pos <> 1)
         UNION ALL SELECT doc_id, 9, title FROM papers WHERE doc_id % 3 = 1 AND doc_id % 5 <> 0),
fedges AS (SELECT citing_id, row_number() OVER (PARTITION BY citing_id ORDER BY pos) - 1 AS pos, {tid('cited_title')} AS cited_id FROM kept),
fdocs AS (SELECT doc_id, title, id, CASE WHEN doc_id % 3 = 1 AND doc_id % 7 = 0 THEN n_chars * 3 ELSE n_chars END AS size FROM papers WHERE doc_id % 3 <> 1 OR doc_id % 5 <> 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, doc_id DESC) AS rn, count(*) OVER (PARTITION BY id) AS n_merged FROM fdocs) WHERE rn = 1),
c AS (SELECT cited_id, count(*) AS n, CAST(sum(citing_id * 7 + pos) AS BIGINT) AS mark FROM fedges GROUP BY 1)
SELECT b.id, b.doc_id, b.title, b.n_merged, coalesce(c.n, 0) AS citations, coalesce(c.n, 0) AS n_listed, coalesce(c.mark, 0) AS mark
FROM best b LEFT JOIN c ON c.cited_id = b.id""")


# ------------------------------------------------------------------ node table, nested lists, report lines
ORACLE["layout_nodes"] = "WITH " + NODES + """
SELECT doc_id, page, CAST(node_id AS INTEGER) AS node_id, lft AS "left", width, top, height,
       lft + width AS "right", top + height AS bottom, lft + width // 2 AS center,
       CASE WHEN i = 0 THEN 1 ELSE 0 END AS font_id, i = 0 AS bold, font_size, text
FROM nodes"""

def chunk_of(citing: str, pos: str) -> str:
    """The chunk of `n_chunks` into which a citation is dealt."""
    return f"CAST(CAST('0x' || substr(md5(CAST({citing} AS VARCHAR) || ':' || CAST({pos} AS VARCHAR)), 1, 15) AS UBIGINT) % n_chunks AS BIGINT)"


ORACLE["incoming_lists"] = with_graph(ctes(
    """every AS (SELECT citing_id * 3000 AS citing_id, pos, cited_id, cited_title FROM edges
              UNION ALL SELECT p.doc_id * 3000, 100, f.id, f.title FROM papers p, (SELECT id, title FROM papers WHERE i = 0) f)""",
    """lst AS (SELECT cited_id AS id, citing_id, pos, cited_title, CAST(ceil(count(*) OVER (PARTITION BY cited_id) / 1000.0) AS BIGINT) AS n_chunks
            FROM every WHERE cited_id IN (SELECT id FROM ded))""",
    f"dealt AS (SELECT *, {chunk_of('citing_id', 'pos')} AS chunk FROM lst)",
) + """
SELECT id, chunk, n_chunks, CAST(count(*) AS INTEGER) AS n_listed,
       arg_min(citing_id, citing_id * 1000 + pos) AS first_citing, CAST(arg_min(pos, citing_id * 1000 + pos) AS INTEGER) AS first_pos,
       CAST(sum(citing_id % 1001) AS BIGINT) AS citing_mod_sum, md5(string_agg(cited_title, '|' ORDER BY citing_id, pos)) AS titles_md5
FROM dealt GROUP BY 1, 2, 3""")

ORACLE["matches_all"] = with_graph("""
SELECT citing_id, cited_id, count(*) AS n FROM (SELECT citing_id, cited_id FROM edges UNION ALL SELECT citing_id, cited_id FROM edges WHERE pos = 0)
WHERE cited_id IN (SELECT id FROM ded) GROUP BY 1, 2""")

ORACLE["first_references"] = with_graph("""
SELECT citing_id, CAST(rank AS INTEGER) AS rank, cited_title, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY citing_id ORDER BY cited_title, pos) AS rank FROM refs) WHERE rank <= 2""")

ORACLE["token_flags"] = with_graph("""
SELECT doc_id, pos, token, lower(token) AS lower, token = upper(token) AS is_upper, lower(token) IN ('and', 'or', 'the', 'if', 'our') AS is_key_word,
       lower(token) IN ('proc.', 'inc.', 'pp.', 'proceedings', 'conference', 'acm', 'ieee', 'usenix') AS is_conference,
       regexp_matches(token, '[0-9]') AS is_numeric, token = upper(token) AND length(token) = 1 AS is_initial, regexp_matches(token, '[0-9]{4}') AS has_date
FROM (SELECT doc_id, unnest(ts) AS token, CAST(unnest(range(len(ts))) AS INTEGER) AS pos
      FROM (SELECT doc_id, string_split(title || ' and THE Proc. of IEEE pp. 1999 X ' || doc_id, ' ') AS ts FROM papers))""")

ORACLE["report_lines"] = ORACLE["evaluation_report"].replace(
    "SELECT f.id, d.title,", "SELECT id, printf('%-60.60s %3d/%3d (%3d) %.2f%%', title, matched, found, total, "
    "100.0 * matched / found) AS line FROM (\nSELECT f.id, d.title,", 1) + ")"


# ------------------------------------------------------------------ long, untidy layouts
ORACLE["layout_long"] = r"""
WITH lines AS (
  SELECT doc_id, CAST(k AS BIGINT) AS i, ls[k + 1] AS line
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k
        FROM (SELECT doc_id, string_split(array_to_string(list_transform(range(60), lambda x: text), chr(10)), chr(10)) AS ls FROM documents))),
nodes AS (
  SELECT doc_id, i + 1 AS node_id, 80 + 20 * CAST(i % 5 AS INTEGER) AS top, 100 + 320 * CAST(i % 2 AS INTEGER) AS lft,
         CAST(least(8 * length(line), 300) AS INTEGER) AS width, i % 11 = 10 AND i % 7 <> 6 AS bold,
         CASE WHEN i % 7 = 6 THEN '' WHEN i % 10 = 9 THEN line || 'é中é&#38;&unknown;' ELSE line END AS text
  FROM lines),""" + LAYOUT_TEXT + r""",
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE bold) AS b, count(*) FILTER (WHERE node_id = 4) > 0 AND doc_id % 13 = 0 AS bad FROM nodes GROUP BY doc_id)
SELECT n.doc_id, CAST(CASE WHEN bad THEN 0 ELSE (n + 4) // 5 END AS INTEGER) AS n_pages, CAST(CASE WHEN bad THEN 0 ELSE n END AS INTEGER) AS n_nodes,
       CAST(CASE WHEN bad THEN 0 ELSE n END AS INTEGER) AS last_id, CAST(CASE WHEN bad THEN 0 ELSE b END AS INTEGER) AS n_bold,
       CAST(CASE WHEN bad THEN 0 ELSE length(t.text) END AS INTEGER) AS text_len, md5(CASE WHEN bad THEN '' ELSE t.text END) AS text_md5
FROM n JOIN doc_text t ON t.doc_id = n.doc_id"""


# ------------------------------------------------------------------ untidy layouts
ORACLE["layout_untidy"] = r"""
WITH nodes AS (
  SELECT doc_id, CAST(k AS BIGINT) AS i, CASE k % 9 WHEN 1 THEN ls[k + 1] || ' 1 < 2' WHEN 4 THEN ls[k + 1] || ' a <b> c</text> &amp; d' ELSE ls[k + 1] END AS text
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
SELECT doc_id, CAST(max(i) // 5 + 1 AS INTEGER) AS n_pages, CAST(count(*) AS INTEGER) AS n_nodes, coalesce(string_agg(CAST(i + 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i % 9 = 8), '') AS bold_ids,
       CAST(sum(CASE WHEN i % 9 = 8 THEN 20 ELSE 10 END * (i + 1) + 80 + 20 * (i % 5)) AS BIGINT) AS mark, md5(string_agg(text, '|' ORDER BY i)) AS texts_md5
FROM nodes GROUP BY doc_id"""


# ------------------------------------------------------------------ file round trips
ORACLE["stored_index"] = ORACLE["index_postings"]
ORACLE["table_round_trip"] = "SELECT doc_id, n_chars, source FROM documents"
ORACLE["epoch_refresh"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN -n_chars ELSE n_chars END AS n_chars, 'e' || CAST(doc_id % 3 + 1 AS VARCHAR) AS epoch,
       CAST(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS version FROM documents"""
ORACLE["wanted_epochs"] = """
WITH d AS (SELECT doc_id, n_chars, 'e' || (doc_id % 7) AS epoch FROM documents)
SELECT * FROM d WHERE epoch IN (SELECT epoch FROM d GROUP BY epoch ORDER BY sum(n_chars) DESC, epoch LIMIT 2)"""
ORACLE["epoch_documents"] = "SELECT doc_id, n_chars, CAST(doc_id % 3 + 1 AS VARCHAR) AS epoch FROM documents"
