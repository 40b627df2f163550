"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import op1_substring, op2_cover_tree, op3_quality, op4_suffix, op5_packing, op6_minhash, op7_html, op8_mixing, op9_exact_dedup, op10_lm_score

MODULES = (op1_substring, op2_cover_tree, op3_quality, op4_suffix, op5_packing, op6_minhash, op7_html, op8_mixing, op9_exact_dedup, op10_lm_score)
QUERIES = {m.__name__.rpartition(".")[2]: m.query for m in MODULES}
SQL = {m.__name__.rpartition(".")[2]: m.SQL for m in MODULES if hasattr(m, "SQL")}
