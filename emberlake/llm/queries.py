"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlake.llm.bpe import op6_bpe
from emberlake.llm.chat_format import OP12_SQL, op12_chat
from emberlake.llm.decontaminate import op5_decontaminate
from emberlake.llm.host_rules import OP3_SQL, op3_host_rules
from emberlake.llm.language import op7_language
from emberlake.llm.html_text import op9_html
from emberlake.llm.line_dedup import OP8_SQL, op8_lines
from emberlake.llm.periodic_runs import op13_runs
from emberlake.llm.simhash import op10_simhash
from emberlake.llm.suffix_dedup import op1_suffix_dedup
from emberlake.llm.surrogates import op2_surrogates
from emberlake.llm.token_alignment import op11_alignment
from emberlake.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_surrogates": op2_surrogates,
    "op3_host_rules": op3_host_rules,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_lines": op8_lines,
    "op9_html": op9_html,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_chat": op12_chat,
    "op13_runs": op13_runs,
}

SQL: dict[str, str] = {
    "op3_host_rules": OP3_SQL,
    "op8_lines": OP8_SQL,
    "op12_chat": OP12_SQL,
}
