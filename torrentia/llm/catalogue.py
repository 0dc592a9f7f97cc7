"""The registered queries of the text operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from torrentia.llm import bpe_codec as op6
from torrentia.llm import chat_format as op1
from torrentia.llm import exact_dedup as op9
from torrentia.llm import html_extract as op10
from torrentia.llm import lang_id as op4
from torrentia.llm import licence_scan as op3
from torrentia.llm import near_dedup as op2
from torrentia.llm import periodic_runs as op12
from torrentia.llm import piece_codec as op13
from torrentia.llm import quality_rules as op7
from torrentia.llm import source_mix as op8
from torrentia.llm import substring_dedup as op5
from torrentia.llm import token_alignment as op11

QUERIES = {
    "op1_chat_format": op1.op1_chat_format,
    "op2_near_dedup": op2.op2_near_dedup,
    "op3_licence_scan": op3.op3_licence_scan,
    "op4_lang_id": op4.op4_lang_id,
    "op5_substring_dedup": op5.op5_substring_dedup,
    "op6_bpe_codec": op6.op6_bpe_codec,
    "op7_quality_rules": op7.op7_quality_rules,
    "op8_source_mix": op8.op8_source_mix,
    "op9_exact_dedup": op9.op9_exact_dedup,
    "op10_html_extract": op10.op10_html_extract,
    "op11_token_alignment": op11.op11_token_alignment,
    "op12_periodic_runs": op12.op12_periodic_runs,
    "op13_piece_codec": op13.op13_piece_codec,
}
SQL = {
    "op3_licence_scan": op3.ORACLE_SQL,
    "op7_quality_rules": op7.ORACLE_SQL,
    "op8_source_mix": op8.ORACLE_SQL,
    "op9_exact_dedup": op9.ORACLE_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
