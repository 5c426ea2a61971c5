"""Queries of the corpus operators for the driver, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from jsonloom.llm import fmindex, langid, license, linedup, minhash, packing, quality, sharding, simhash, tokencount

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language_id": langid.op2_language_id,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_fingerprints": minhash.op4_fingerprints,
    "op5_decontamination": fmindex.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_license_scan": license.op8_license_scan,
    "op9_line_dedup": linedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "pipeline": corpus_pipeline.run,
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    # windows by their text; every document window of a length that some item window has
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
wins AS (SELECT item_id, least(13, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i, w FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM wins),
places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, i, p.size FROM places p JOIN phrases f ON p.size = f.size AND f.phrase = array_to_string(list_slice(w, i, i + p.size - 1), ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id)""",
    # lines by all pairs of nearly equal length; classes by following links
    "op9_line_dedup": """
WITH RECURSIVE l AS (SELECT doc_id, pos - 1 AS pos, regexp_replace(regexp_replace(line, '^[ \\t\\r\\x0B\\f]+', ''), '[ \\t\\r\\x0B\\f]+$', '') AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
places AS (SELECT * FROM l WHERE line <> ''),
lines AS (SELECT line, strlen(line) AS n, min((doc_id, pos)) AS first FROM places GROUP BY 1),
pairs AS (SELECT a.line AS a, b.line AS b FROM lines a JOIN lines b ON b.n IN (a.n, a.n + 1) AND a.line <> b.line
    WHERE (left(a.line, (length(a.line) // 2)::INT) = left(b.line, (length(a.line) // 2)::INT) OR right(a.line, ((length(a.line) - 1) // 2)::INT) = right(b.line, ((length(a.line) - 1) // 2)::INT)
    OR a.n <> length(a.line) OR b.n <> length(b.line)) AND levenshtein(a.line, b.line) <= 1),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT line, line FROM lines WHERE line IN (SELECT a FROM links) UNION SELECT r.a, k.b FROM reach r JOIN links k ON r.b = k.a),
classes AS (SELECT r.a AS line, min(x.first) AS kept FROM reach r JOIN lines x ON x.line = r.b GROUP BY 1),
kept AS (SELECT line, coalesce(kept, first) AS kept FROM lines LEFT JOIN classes USING (line)),
gone AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM places JOIN kept USING (line) WHERE (doc_id, pos) <> kept GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM places GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN gone g USING (doc_id)""",
}
