"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_alignment
from .language import op8_language_id
from .lines import ORACLE as OP13_SQL
from .lines import op13_line_dedup
from .mixing import op5_mixing
from .neighbours import op7_one_bit_search
from .packing import op6_packing
from .quality import op9_quality_rules
from .quotes import ORACLE as OP3_SQL
from .quotes import op3_quotation_linking
from .shards import ORACLE as OP10_SQL
from .shards import op10_compaction
from .simhash import op2_simhash
from .spelling import op11_spelling
from .token_files import op4_token_files
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_one_bit_search": op7_one_bit_search,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_compaction": op10_compaction,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op3_quotation_linking": OP3_SQL, "op10_compaction": OP10_SQL, "op13_line_dedup": OP13_SQL}
