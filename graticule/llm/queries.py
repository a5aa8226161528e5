"""Queries of the training-data operators and the SQL that checks them, by name."""

from __future__ import annotations

from . import ann, decontaminate, license_scan, line_templates, mixing, simhash, suffix_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_token_files": token_files.op5_token_files,
    "op6_mixing": mixing.op6_mixing,
    "op7_ann": ann.op7_ann,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_templates": line_templates.op9_line_templates,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: Left out where SQL can't express the operator; tests/llm holds those against brute force.
ORACLES = {"op3_license_scan": license_scan.OP3_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op8_url_filter": url_filter.OP8_SQL}
