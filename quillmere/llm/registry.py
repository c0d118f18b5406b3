"""Queries of the llm operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from quillmere.llm.byte_bpe import op5_byte_bpe
from quillmere.llm.decontaminate import op8_decontaminate
from quillmere.llm.licenses import op7_license_scan
from quillmere.llm.pii import op10_pii
from quillmere.llm.quality import op6_quality_rules
from quillmere.llm.simhash import op9_simhash
from quillmere.llm.sql import SQL
from quillmere.llm.substrings import op1_substring_dedup
from quillmere.llm.suffixes import op4_suffix_dedup
from quillmere.llm.token_counts import op2_token_counts
from quillmere.llm.token_files import op3_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_token_files,
        op4_suffix_dedup,
        op5_byte_bpe,
        op6_quality_rules,
        op7_license_scan,
        op8_decontaminate,
        op9_simhash,
        op10_pii,
    )
}
__all__ = ["QUERIES", "SQL"]
