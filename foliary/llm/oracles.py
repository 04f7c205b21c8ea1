"""SQL twins of those queries that SQL can express."""

from __future__ import annotations

from foliary.llm.chat import CONTROL, END, TURN

_CAPITALS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACES = r"[^\x20\x09-\x0D]+"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM (SELECT {key}, regexp_extract_all({_CAPITALS.format('text')}, '{pattern}') AS w FROM {table})"


OP2 = f"""
WITH dw AS ({_words("documents", "doc_id", _LETTERS)}),
iw AS ({_words("benchmark", "item_id", _LETTERS)}),
il AS (SELECT item_id, p, count(*) OVER (PARTITION BY item_id) AS total, list(word) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM iw),
win AS (SELECT DISTINCT item_id, len(ws) AS n, array_to_string(ws, ' ') AS k FROM il WHERE len(ws) = least(total, 10)),
sizes AS (SELECT DISTINCT n FROM win),
dl AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM dw),
pos AS (SELECT doc_id, p, n, array_to_string(ws[1:n], ' ') AS k FROM dl, sizes WHERE len(ws) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM pos JOIN win USING (n, k)),
marks AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN marks USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_MARKS = "|".join(rf"{'[' + c[0] + ']' if c[0] == '<' else chr(92) + c[0]}\\*" + "".join(chr(92) + x if x in "|[]" else x for x in c[1:]) for c in CONTROL)

OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN)} + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_MARKS}')) + {len(END)} + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8 = f"""
WITH RECURSIVE w AS ({_words("documents", "doc_id", _SPACES)}),
g AS (SELECT doc_id, p, word, lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS after, count(*) OVER (PARTITION BY doc_id) AS total FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN total = 1 THEN word ELSE word || ' ' || after END AS shingle FROM g WHERE total = 1 OR after IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size i ON i.doc_id = x JOIN size j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.node WHERE r.root < b.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""



def _clusters(rounds: int = 3, centroids: int = 16) -> str:
    """Rounds of assignment and floored means, one common table each; rows are told apart by a number."""
    parts = [
        "x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "cell AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS e FROM x)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM x QUALIFY c < {centroids})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT r, c, d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(x.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x, c{n}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, list(e ORDER BY i) AS v FROM (SELECT c, i, CAST(floor(sum(e) / count(*)) AS BIGINT) AS e FROM a{n} JOIN cell USING (r) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))")
    last = f"SELECT x.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM x JOIN a{rounds} a USING (r) JOIN c{rounds} k ON k.c = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + last


OP11 = _clusters()

OP12 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_SPACES}') AS w FROM documents),
w AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM t WHERE len(w) >= 20),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS rest FROM w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY 1)
SELECT t.doc_id, coalesce(len(t.w), 0) AS n_words, coalesce(len(t.w), 0) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.rest, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

ORACLES = {"op11_centroid_clusters": OP11, "op12_substring_dedup": OP12, "op2_benchmark_decontamination": OP2, "op7_chat_formatting": OP7, "op8_near_duplicates": OP8}
