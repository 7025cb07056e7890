"""Registered queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from codeweigh.llm import decontaminate, exact_dedup, near_dedup, periodic_runs, ranked_search, substring_dedup
from codeweigh.llm.decontaminate import op9_decontaminate
from codeweigh.llm.exact_dedup import op8_exact_dedup
from codeweigh.llm.html_text import op7_html_text
from codeweigh.llm.language import op10_language_id
from codeweigh.llm.near_dedup import op4_near_dedup
from codeweigh.llm.periodic_runs import op13_periodic_runs
from codeweigh.llm.personal_data import op5_personal_data
from codeweigh.llm.pieces import op1_sentencepiece
from codeweigh.llm.ranked_search import op12_ranked_search
from codeweigh.llm.simhash import op11_simhash_near_dedup
from codeweigh.llm.substring_dedup import op2_substring_dedup
from codeweigh.llm.token_files import op3_token_files
from codeweigh.llm.toxicity import op6_toxicity

QUERIES = {
    "op6_toxicity": op6_toxicity,
    "op5_personal_data": op5_personal_data,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op1_sentencepiece": op1_sentencepiece,
    "op7_html_text": op7_html_text,
    "op3_token_files": op3_token_files,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Queries without an entry here are tested against brute force, a round trip or held-out labels in tests/llm.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
