"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from chalkline.llm.bpe import op2_bpe_round_trip
from chalkline.llm.jaccard import JACCARD_SQL, op9_jaccard_components
from chalkline.llm.language import op10_language_id
from chalkline.llm.packing import op1_best_fit_packing
from chalkline.llm.periodic_runs import op11_periodic_runs
from chalkline.llm.prefix_trie import TRIE_SQL, op12_prefix_trie
from chalkline.llm.quality_model import op4_quality_classifier
from chalkline.llm.quality_rules import op3_quality_rules, verdict_sql
from chalkline.llm.substring_dedup import op6_substring_dedup
from chalkline.llm.token_counts import op13_token_counts
from chalkline.llm.token_files import op8_token_files
from chalkline.llm.top_k import TOP_K_SQL, op7_exact_top_k
from chalkline.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_bpe_round_trip,
        op3_quality_rules,
        op4_quality_classifier,
        op5_toxicity,
        op6_substring_dedup,
        op7_exact_top_k,
        op8_token_files,
        op9_jaccard_components,
        op10_language_id,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_token_counts,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": verdict_sql(), "op7_exact_top_k": TOP_K_SQL, "op9_jaccard_components": JACCARD_SQL, "op12_prefix_trie": TRIE_SQL}
