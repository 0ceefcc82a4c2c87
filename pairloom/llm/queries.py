"""The registered queries of this subpackage, and SQL for those that have any."""

from __future__ import annotations

from pairloom.llm.contamination import op3_decontaminate
from pairloom.llm.html import op7_html_text
from pairloom.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from pairloom.llm.language import op9_language_id
from pairloom.llm.mixing import OP8_SQL, op8_mix_sources
from pairloom.llm.packing import op1_pack_tokens
from pairloom.llm.pii import op2_personal_data
from pairloom.llm.pivots import OP5_SQL, op5_embedding_dedup
from pairloom.llm.secrets import OP6_SQL, op6_secret_scan
from pairloom.llm.tokens import op10_count_tokens

QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_tokens,
        op2_personal_data,
        op3_decontaminate,
        op4_ngram_jaccard,
        op5_embedding_dedup,
        op6_secret_scan,
        op7_html_text,
        op8_mix_sources,
        op9_language_id,
        op10_count_tokens,
    )
}

ORACLES = {"op4_ngram_jaccard": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op6_secret_scan": OP6_SQL, "op8_mix_sources": OP8_SQL}
