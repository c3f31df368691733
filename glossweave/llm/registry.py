"""The registered queries of this folder, and SQL for those that SQL can express."""

from glossweave.llm.decontaminate import op9_benchmark_decontamination
from glossweave.llm.html_text import op13_html_extraction
from glossweave.llm.importance import OP12_SQL, op12_importance_resampling
from glossweave.llm.language_model import op7_language_model
from glossweave.llm.lattice import op2_lattice_hashing
from glossweave.llm.line_dedup import OP5_SQL, op5_line_dedup
from glossweave.llm.packing import op8_vector_packing
from glossweave.llm.quality import op6_quality
from glossweave.llm.simhash import op1_simhash_pivots
from glossweave.llm.spelling import OP11_SQL, op11_spelling_variants
from glossweave.llm.token_counts import op10_token_counts
from glossweave.llm.token_files import op3_token_files
from glossweave.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_pivots, op2_lattice_hashing, op3_token_files, op4_toxicity, op5_line_dedup, op6_quality, op7_language_model, op8_vector_packing, op9_benchmark_decontamination, op10_token_counts,
        op11_spelling_variants, op12_importance_resampling, op13_html_extraction,
    )
}
ORACLE_SQL = {"op5_line_dedup": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op12_importance_resampling": OP12_SQL}
