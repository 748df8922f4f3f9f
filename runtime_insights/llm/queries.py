"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from runtime_insights.llm.exact_topk import OP4_SQL, op4_exact_topk
from runtime_insights.llm.filter_audit import OP12_SQL, op12_filter_audit
from runtime_insights.llm.graph_ann import op2_graph_ann
from runtime_insights.llm.line_dedup import op5_line_dedup
from runtime_insights.llm.lm_scoring import OP1_SQL, op1_lm_scoring
from runtime_insights.llm.packing import op10_best_fit_packing
from runtime_insights.llm.periodic_runs import op13_periodic_runs
from runtime_insights.llm.quality import op9_quality_classifier
from runtime_insights.llm.secret_scan import op6_secret_scan
from runtime_insights.llm.sentencepiece_fst import op7_sentencepiece
from runtime_insights.llm.simhash import op8_simhash_near_dedup
from runtime_insights.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from runtime_insights.llm.url_filter import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_graph_ann": op2_graph_ann,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
TWINS = {
    "op1_lm_scoring": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_exact_topk": OP4_SQL,
    "op11_url_filter": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
