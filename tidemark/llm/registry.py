"""The corpus queries: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from tidemark.llm import decontamination, divergence, url_filter
from tidemark.llm.decontamination import op6_decontamination
from tidemark.llm.divergence import op12_source_divergence
from tidemark.llm.embedding_dedup import op13_embedding_dedup
from tidemark.llm.fingerprints import op4_fingerprints
from tidemark.llm.language_id import op10_language_id
from tidemark.llm.mixing import op3_mixing
from tidemark.llm.simhash import op7_simhash
from tidemark.llm.suffix_dedup import op2_suffix_dedup
from tidemark.llm.token_alignment import op11_token_alignment
from tidemark.llm.token_counts import op9_token_counts
from tidemark.llm.token_output import op5_token_output
from tidemark.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (url_filter.op1_url_filter, op2_suffix_dedup, op3_mixing, op4_fingerprints, op5_token_output, op6_decontamination, op7_simhash, op8_toxicity, op9_token_counts, op10_language_id, op11_token_alignment, op12_source_divergence, op13_embedding_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.oracle(), "op6_decontamination": decontamination.oracle(), "op12_source_divergence": divergence.oracle()}
