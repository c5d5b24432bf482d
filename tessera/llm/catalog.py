"""Named queries of the training-data operators; each module is imported when its query is first asked for."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_pii": "pii",
    "op2_byte_bpe": "byte_bpe",
    "op3_toxicity": "toxicity",
    "op4_substring": "substring",
    "op5_licenses": "licenses",
    "op6_minhash": "minhash",
    "op7_packing": "packing",
    "op8_ann": "ann",
    "op9_langid": "langid",
    "op10_vector_dedup": "vector_dedup",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"tessera.llm.{MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


_OP4 = r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
own AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN own USING (g), (SELECT unnest(range(13)) AS k) WHERE lo < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM r WHERE a = vec_id) AS kept FROM v"""


def oracle_sql() -> dict:
    """SQL where it can express an operator; the others are tested against brute force in tests/llm."""
    return {"op4_substring": _OP4, "op10_vector_dedup": _OP10}
