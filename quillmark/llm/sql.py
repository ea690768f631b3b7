"""SQL of the training-data queries that SQL can express.

The others are learned, approximate or built on Unicode tables and automata;
tests/llm holds them against brute force, round trips or held-out rows.
"""

P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(nfc_normalize(lower(text)), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(nfc_normalize(lower(text)), '[\p{L}\p{M}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dk AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12),
ik AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM dk),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM ik)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P8_LEAKED_ITEMS = P8_FOUND.split("dg AS")[0] + r"""
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM dk),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM ik),
m AS (SELECT item_id, doc_id, count(DISTINCT k) + 11 AS n FROM dg JOIN ig USING (g) GROUP BY 1, 2)
SELECT item_id, count(*) AS documents, max(n) AS longest_words FROM m GROUP BY item_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p8_found": P8_FOUND, "p8_leaked_items": P8_LEAKED_ITEMS}
