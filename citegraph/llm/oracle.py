"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingles(k: int) -> str:
    return f"""list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})] END)"""


OP7 = f"""
WITH RECURSIVE sets AS (
  SELECT doc_id, {_shingles(3)} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP1 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (
  SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
n1 AS (SELECT c, count(*) AS n FROM pos GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM pos WHERE i > 1 GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM pos WHERE i > 2 GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM pos),
s AS (
  SELECT p.doc_id, CASE WHEN n3.n >= 1 THEN ln(n3.n / ctx2.n)
                        WHEN n2.n >= 1 THEN ln(n2.n / ctx1.n) + CASE WHEN p.i > 2 THEN ln(0.4) ELSE 0 END
                        ELSE ln(n1.n / total.n) + (least(p.i, 3) - 1) * ln(0.4) END AS score
  FROM pos p JOIN n1 ON n1.c = p.c CROSS JOIN total
  LEFT JOIN n1 ctx1 ON ctx1.c = p.b
  LEFT JOIN n2 ON n2.b = p.b AND n2.c = p.c
  LEFT JOIN n2 ctx2 ON ctx2.b = p.a AND ctx2.c = p.b
  LEFT JOIN n3 ON n3.a = p.a AND n3.b = p.b AND n3.c = p.c)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(x.score, 0.0), 3) AS score, round(x.score / len(d.w), 6) AS mean_score
FROM docs d LEFT JOIN (SELECT doc_id, sum(score) AS score FROM s GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""

_PLAIN = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+')"

OP8 = f"""
WITH items AS (SELECT item_id, len(s) AS n, unnest(s) AS sh FROM (SELECT item_id, {_shingles(5)} AS s FROM (SELECT item_id, {_PLAIN} AS w FROM benchmark))),
plain AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
short AS (SELECT DISTINCT len(w) AS k FROM (SELECT {_PLAIN} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4),
docs AS (SELECT doc_id, unnest(s) AS sh FROM (SELECT doc_id, {_shingles(5)} AS s FROM plain WHERE len(w) >= 5)
         UNION ALL
         SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))) AS sh
         FROM plain JOIN short ON len(w) >= k)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, CAST(i.n AS BIGINT) AS n_item, count(*) / i.n AS containment
FROM docs d JOIN items i ON i.sh = d.sh GROUP BY d.doc_id, i.item_id, i.n HAVING 100 * count(*) >= 80 * i.n
"""

OP9 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'text|' || md5(coalesce(text, '')))), 1, 3) AS block, md5(coalesce(text, '')) AS mark,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
sums AS (SELECT name, sum(n_tokens) AS tokens FROM docs GROUP BY name),
shares AS (SELECT name, CAST(tokens AS BIGINT) AS tokens, tokens / (SELECT sum(tokens) FROM sums) AS p FROM sums WHERE tokens > 0),
ps AS (SELECT list(p ORDER BY name) AS l, count(*) AS k FROM shares),
bisect(i, lo1, hi1, lo2, hi2) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN even THEN m1 ELSE lo1 END, CASE WHEN even THEN hi1 ELSE m1 END, CASE WHEN few THEN lo2 ELSE m2 END, CASE WHEN few THEN m2 ELSE hi2 END
  FROM (SELECT b.*, (lo1 + hi1) / 2 AS m1, (lo2 + hi2) / 2 AS m2,
               ln(list_sum(list_transform(l, lambda x: pow(x, (lo1 + hi1) / 2))))
               - list_sum(list_transform(l, lambda x: pow(x, (lo1 + hi1) / 2) * ln(pow(x, (lo1 + hi1) / 2))))
                 / list_sum(list_transform(l, lambda x: pow(x, (lo1 + hi1) / 2))) >= 0.97 * ln(k) AS even,
               list_max(list_transform(l, lambda x: pow(x, (lo2 + hi2) / 2) / x)) <= 2.0 * list_min(list_transform(l, lambda x: pow(x, (lo2 + hi2) / 2) / x)) AS few
        FROM bisect b, ps) WHERE i < 48),
found AS (SELECT CASE WHEN k > 1 THEN round(greatest(lo1, hi2), 10) ELSE 1.0 END AS a FROM bisect, ps WHERE i = 48),
epochs AS (SELECT name, tokens, pow(p, a) / p / (SELECT min(pow(p, a) / p) FROM shares, found) AS e FROM shares, found
           UNION ALL SELECT name, 0, 1.0 FROM sums WHERE coalesce(tokens, 0) = 0),
plan AS (SELECT name, CAST(floor(e + 1e-9) AS BIGINT) AS full_passes, greatest(floor((e - floor(e + 1e-9)) * tokens + 1e-6), 0) AS room FROM epochs),
blocks AS (SELECT d.name, d.block, p.room, md5('mix|' || d.name || '|' || (p.full_passes + 1) || '|' || d.block) AS draw, sum(n_tokens) AS n
           FROM docs d JOIN plan p ON p.name = d.name WHERE p.room > 0 GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY draw) AS upto FROM blocks),
cut AS (SELECT name, min(draw) AS draw, arg_min(room - upto + n, draw) AS room FROM run WHERE upto > room GROUP BY name),
chosen AS (
  SELECT d.*, p.full_passes, c.draw AS last, c.room, md5('mix|' || d.name || '|' || (p.full_passes + 1) || '|' || d.block) AS draw
  FROM docs d JOIN plan p ON p.name = d.name LEFT JOIN cut c ON c.name = d.name),
edge AS (SELECT doc_id, sum(n_tokens) OVER (PARTITION BY name ORDER BY md5('mix|' || (full_passes + 1) || '|' || coalesce(CAST(doc_id AS VARCHAR), 'text|' || mark)), n_tokens, mark ROWS UNBOUNDED PRECEDING) <= room AS fits
         FROM chosen WHERE draw = last),
times AS (SELECT c.*, full_passes + CASE WHEN draw < last OR coalesce(e.fits, false) THEN 1 ELSE 0 END AS n FROM chosen c LEFT JOIN edge e ON e.doc_id = c.doc_id)
SELECT doc_id, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS epoch, block, n_tokens FROM times
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings e JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) c ON c.id = e.vec_id
"""

# the pages' main text is their article element; they use these character references only
OP4 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM b)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM c
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length('<|turn|><|text|><|end|>') + length(role) + length(text) + (length(text) - length(replace(text, chr(92), '')))
                 + 2 * len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) AS formatted FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

# CRC-32 of a decimal number, bit by bit (its polynomial in reversed bit order)
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), CAST(4294967295 AS BIGINT))"""


def _merkle(levels: int) -> str:
    """OP13, for trees of up to 3 ** `levels` leaves: every level of the trees, of the proofs and of the folded leaves is a step of its own."""

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"

    def trees(t: str) -> list[str]:
        """`t`_0 (tree, pos, digest) upwards; a run's digests, and the place of a node in its run."""
        out = []
        for k in range(levels):
            out.append(f"""{t}_{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest,
  CASE WHEN any_value(n) > 1 THEN list(digest ORDER BY pos) ELSE [] END AS run
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {t}_{k}) GROUP BY tree, pos // 3)""")
        return out

    def proofs(t: str, base: str) -> list[str]:
        """`base` (tree, pos, proof, folded, ...) with the siblings of all levels of `t`."""
        out = []
        for k in range(levels):
            power, place = 3**k, f"CAST(b.pos // {3**k} % 3 AS INTEGER)"
            out.append(f"""{base}_{k + 1} AS (SELECT b.* REPLACE (
    b.proof || list_aggregate(list_concat([''], list_concat(r.run[:{place}], r.run[{place} + 2:])), 'string_agg', '') AS proof,
    CASE WHEN len(r.run) = 0 THEN b.folded ELSE sha256(list_aggregate(list_concat(r.run[:{place}], list_concat([b.folded], r.run[{place} + 2:])), 'string_agg', '')) END AS folded)
  FROM {base}_{k} b JOIN {t}_{k + 1} r ON r.tree = b.tree AND r.pos = b.pos // {3 * power})""")
        return out

    crc = _CRC32.format(x="CAST(doc_id AS VARCHAR)")
    rows = f"""rows_0 AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
  coalesce({crc} % 2 = 0, false) AS hit FROM documents)"""
    leaves = f"""leaves AS (SELECT doc_id, tree, sha256(head || {field("text")}) AS digest, sha256(head || {field("CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END")}) AS folded FROM rows_0),
s_0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves)"""
    top = f"t_0 AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM s_{levels})"
    docs = "d_0 AS (SELECT doc_id, tree, pos, digest, folded, '' AS proof FROM s_0)"
    over = f"e_0 AS (SELECT d.doc_id, d.digest, d.folded, d.proof, '' AS tree, t.pos, t.digest AS subroot FROM d_{levels} d JOIN t_0 t ON t.name = d.tree)"
    ctes = [rows, leaves, *trees("s"), docs, *proofs("s", "d"), top, *trees("t"), over, *proofs("t", "e")]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, e.digest AS leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM e_{levels} e, t_{levels} r"""


OP13 = _merkle(11)

ORACLE = {
    "op1_lm_scoring": OP1,
    "op3_embedding_near_dedup": OP3,
    "op4_html_extraction": OP4,
    "op6_chat_formatting": OP6,
    "op7_ngram_jaccard_join": OP7,
    "op8_benchmark_decontamination": OP8,
    "op9_source_mixing": OP9,
    "op11_hard_negatives": OP11,
    "op13_merkle_manifest": OP13,
}
