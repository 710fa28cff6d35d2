"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chunking, funcdocs, leakage, mixing, neardup, provenance, spam, syntax
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, at: function(*(table(spark, at, n) for n in names))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(funcdocs.found, "docs"),
        "p1_function_docs": _on(funcdocs.function_docs, "docs"),
        "p2_found": _on(neardup.found, "docs"),
        "p2_classes": _on(neardup.classes, "docs"),
        "p2_copies": _on(neardup.copies, "docs"),
        "p3_found": _on(syntax.invalid, "docs"),
        "p3_rates": _on(syntax.invalid_rates, "docs"),
        "p4_found": _on(ann.found, "tree_nodes"),
        "p4_neighbours": _on(ann.neighbours, "tree_nodes"),
        "p5_found": _on(chunking.found, "docs", "tree_nodes", "size_limits"),
        "p5_pieces": _on(chunking.split_all, "docs", "tree_nodes", "size_limits"),
        "p6_found": _on(provenance.found, "docs"),
        "p6_kinds": _on(provenance.not_handwritten, "docs"),
        "p7_found": _on(leakage.found, "documents", "eval_items"),
        "p7_items": _on(leakage.leaked_items, "documents", "eval_items"),
        "p7_near": _on(leakage.proximity, "documents", "eval_items"),
        "p8_mixture": _on(mixing.mixture, "documents", "mix_targets"),
        "p8_shares": _on(mixing.shares, "documents", "mix_targets"),
        "p9_found": _on(spam.found, "documents"),
        "p9_scores": _on(spam.score_pages, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH t AS (SELECT DISTINCT doc_id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS w FROM docs WHERE code <> ''),
            s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) > 2),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            p AS (SELECT doc_id_a, doc_id_b FROM c JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE 10 * k >= 7 * (x.n + y.n - k)),
            f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY code) = doc_id AS is_first FROM (SELECT DISTINCT doc_id, code FROM docs WHERE code <> ''))
            SELECT doc_id_a, doc_id_b FROM p JOIN f x ON x.doc_id = doc_id_a JOIN f y ON y.doc_id = doc_id_b WHERE x.is_first OR y.is_first
        """,
        "p2_classes": """
            WITH RECURSIVE t AS (SELECT DISTINCT doc_id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS w FROM docs WHERE code <> ''),
            s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) > 2),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 7 * (x.n + y.n - k)),
            ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            walk(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT walk.doc_id, b FROM walk JOIN ways ON a = node),
            named AS (SELECT doc_id, min(node) AS class_id FROM walk GROUP BY doc_id)
            SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS members FROM named
        """,
        "p2_copies": """
            WITH t AS (SELECT DISTINCT doc_id, code FROM docs WHERE code <> '' AND len(regexp_extract_all(code, '[A-Za-z0-9_]+')) > 2)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY code) AS first_doc_id, count(*) OVER (PARTITION BY code) AS copies FROM t
        """,
        "p4_found": """
            WITH u AS (SELECT DISTINCT node_key, graph_node_data.embedding::DOUBLE[] AS e FROM tree_nodes WHERE len(graph_node_data.embedding) = 64
              AND len(list_filter(graph_node_data.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(graph_node_data.embedding, lambda x: x <> 0)) > 0),
            r AS (SELECT a.node_key AS a, b.node_key AS b, row_number() OVER (PARTITION BY a.node_key ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.node_key) AS k FROM u a JOIN u b ON a.node_key <> b.node_key)
            SELECT DISTINCT least(a, b) AS node_key_a, greatest(a, b) AS node_key_b FROM r WHERE k <= 5
        """,
        "p7_found": """
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', '', 'g')), '[a-z0-9_]+') AS w FROM documents WHERE text <> ''),
            e AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', '', 'g')), '[a-z0-9_]+') AS w FROM eval_items WHERE text <> ''),
            g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i : i + 11], ' '))) AS x FROM d WHERE len(w) >= 12),
            h AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i : i + 11], ' '))) AS x FROM e WHERE len(w) >= 12)
            SELECT DISTINCT doc_id, item_id FROM g JOIN h ON g.x = h.x
        """,
        "p7_near": """
            WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', '', 'g')), '[a-z0-9_]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')),
            e AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', '', 'g')), '[a-z0-9_]+') AS w FROM (SELECT DISTINCT item_id, text FROM eval_items WHERE text <> '')),
            tok AS (SELECT k, doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d), df AS (SELECT term, count(DISTINCT k) AS n FROM tok GROUP BY term),
            own AS (SELECT item_id, greatest(len(w), 24) AS reach, len(list_distinct(w)) AS size, unnest(list_distinct(w)) AS term FROM e WHERE len(w) >= 12),
            held AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS have, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r FROM own JOIN df USING (term)),
            centres AS (SELECT DISTINCT k, doc_id, item_id, pos, reach, size FROM held JOIN tok USING (term) WHERE r <= have - ceil(0.8 * size - 1e-9) + 1),
            near AS (SELECT c.doc_id, c.item_id, c.k, c.pos, c.size, count(DISTINCT t.term) AS m FROM centres c JOIN tok t ON t.k = c.k AND t.pos BETWEEN c.pos - c.reach AND c.pos + c.reach JOIN own o ON o.item_id = c.item_id AND o.term = t.term GROUP BY ALL)
            SELECT doc_id, item_id, round(max(m / size), 6) AS near_share FROM near WHERE m / size >= 0.8 GROUP BY doc_id, item_id
        """,
        "p5_found": """
            WITH items AS (
                SELECT 'docs.code' AS field_name, doc_id AS item_key, code AS text FROM docs
                UNION ALL SELECT 'tree_nodes.code', CAST(node_key AS VARCHAR), graph_node_data.code FROM tree_nodes
                UNION ALL SELECT 'tree_nodes.description', CAST(node_key AS VARCHAR), graph_node_data.description FROM tree_nodes)
            SELECT DISTINCT items.field_name, item_key FROM items JOIN size_limits ON items.field_name = size_limits.field_name
            WHERE length(text) > max_chars
        """,
    }
