"""The training-data queries and those of their results that SQL can express."""

from __future__ import annotations

from lamina.llm.bpe import op9_bpe
from lamina.llm.hilbert_ann import SQL as HILBERT_ANN
from lamina.llm.hilbert_ann import op1_hilbert_ann
from lamina.llm.html_extraction import op6_html_extraction
from lamina.llm.line_dedup import SQL as LINE_DEDUP
from lamina.llm.line_dedup import op10_line_dedup
from lamina.llm.mixing import op4_mixing
from lamina.llm.ngram_join import SQL as NGRAM_JOIN
from lamina.llm.ngram_join import op5_ngram_join
from lamina.llm.pii import op8_pii
from lamina.llm.quality_classifier import op7_quality_classifier
from lamina.llm.quality_rules import op2_quality_rules
from lamina.llm.substring_dedup import op3_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_ann, op2_quality_rules, op3_substring_dedup, op4_mixing, op5_ngram_join,
        op6_html_extraction, op7_quality_classifier, op8_pii, op9_bpe, op10_line_dedup,
    )
}
ORACLE_SQL = {"op1_hilbert_ann": HILBERT_ANN, "op5_ngram_join": NGRAM_JOIN, "op10_line_dedup": LINE_DEDUP}
