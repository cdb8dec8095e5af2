"""The driver's queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quadloom.llm.bpe import op8_byte_bpe
from quadloom.llm.ctph import op3_ctph
from quadloom.llm.html import op4_main_text
from quadloom.llm.lines import OP10_SQL, op10_line_runs
from quadloom.llm.mixing import OP7_SQL, op7_curriculum_mix
from quadloom.llm.pii import op5_personal_data
from quadloom.llm.quality import op2_quality_qda
from quadloom.llm.rules import op9_quality_rules
from quadloom.llm.simhash import op6_simhash
from quadloom.llm.token_counts import op1_section_tokens

QUERIES = {
    "op1_section_tokens": op1_section_tokens,
    "op2_quality_qda": op2_quality_qda,
    "op3_ctph": op3_ctph,
    "op4_main_text": op4_main_text,
    "op5_personal_data": op5_personal_data,
    "op6_simhash": op6_simhash,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_runs": op10_line_runs,
}

SQL: dict[str, str] = {"op7_curriculum_mix": OP7_SQL, "op10_line_runs": OP10_SQL}
