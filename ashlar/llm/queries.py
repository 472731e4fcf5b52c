"""The operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .exact_dedup import op3_exact_dedup
from .html_text import op5_html_text
from .merkle_manifest import ORACLE as OP12_ORACLE
from .merkle_manifest import op12_merkle_manifest
from .mixing import op7_mix_sources
from .near_dedup import op8_near_dedup
from .recurrent_lm import op11_recurrent_lm
from .repeats import op10_repeated_strings
from .secrets import op2_secret_scan
from .token_store import op1_token_store
from .toxicity import op6_toxicity
from .url_filter import ORACLE as OP4_ORACLE
from .url_filter import op4_url_filter
from .wavelet_search import ORACLE as OP13_ORACLE
from .wavelet_search import op13_ranked_search

QUERIES = {f.__name__: f for f in (op1_token_store, op2_secret_scan, op3_exact_dedup, op4_url_filter, op5_html_text, op6_toxicity, op7_mix_sources, op8_near_dedup, op9_decontaminate, op10_repeated_strings, op11_recurrent_lm, op12_merkle_manifest, op13_ranked_search)}

ORACLES = {
    "op4_url_filter": OP4_ORACLE,
    "op12_merkle_manifest": OP12_ORACLE,
    "op13_ranked_search": OP13_ORACLE,
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
}
