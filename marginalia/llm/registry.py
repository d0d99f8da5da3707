"""The queries of this subpackage and, where SQL can express one, its equivalent."""

from __future__ import annotations

import corpus_pipeline
from marginalia.llm import chat, decontaminate, host_rules, line_spread, mixing, near_dups, pseudonyms, token_counts, token_files, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_warc": warc.op2_warc,
    "op3_host_rules": host_rules.op3_host_rules,
    "op4_pseudonyms": pseudonyms.op4_pseudonyms,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat": chat.op6_chat,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_spread": line_spread.op8_line_spread,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_near_dups": near_dups.op10_near_dups,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_host_rules": host_rules.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_line_spread": line_spread.OP8_SQL,
}
