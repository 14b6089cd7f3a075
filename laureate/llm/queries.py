"""The queries of this package, by name, and their DuckDB statements."""

from __future__ import annotations

from laureate.llm import conversations, rotation
from laureate.llm.bestfit import op11_best_fit
from laureate.llm.conversations import op13_zfast_trie
from laureate.llm.decontaminate import op7_prefix_filtered_join
from laureate.llm.language import op1_hidden_markov
from laureate.llm.lines import op2_line_dedup
from laureate.llm.neardup import op4_chosen_path
from laureate.llm.packing import op8_optimal_buckets
from laureate.llm.privacy import op9_disclosure
from laureate.llm.quality import op10_compression_quality
from laureate.llm.rotation import op12_block_rotation
from laureate.llm.sharding import op6_histogram_sort
from laureate.llm.topk import op5_block_pruning
from laureate.llm.warc import op3_warc_ranges

QUERIES = {q.__name__: q for q in (
    op1_hidden_markov,
    op2_line_dedup,
    op3_warc_ranges,
    op4_chosen_path,
    op5_block_pruning,
    op6_histogram_sort,
    op7_prefix_filtered_join,
    op8_optimal_buckets,
    op9_disclosure,
    op10_compression_quality,
    op11_best_fit,
    op12_block_rotation,
    op13_zfast_trie,
)}

ORACLE: dict[str, str] = {
    "op5_block_pruning": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
            CAST(row_number() OVER (
                PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id
            ) AS INTEGER) AS rank
        FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        QUALIFY rank <= 20
    """,
    "op3_warc_ranges": """
        WITH bodies AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages
        ), kept AS (
            SELECT body, max(page_id) AS kept FROM bodies WHERE size >= 1000 GROUP BY body
        )
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
            CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < kept THEN kept END AS refers_to
        FROM bodies LEFT JOIN kept USING (body)
    """,
    "op12_block_rotation": rotation.SQL,
    "op13_zfast_trie": conversations.SQL,
}
