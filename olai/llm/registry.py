"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

import corpus_pipeline
from olai.llm import op1_url_filter, op2_mixing, op3_toxicity, op4_licenses, op5_simhash, op6_suffix_dedup, op7_secrets, op8_line_dedup, op9_topk, op10_decontamination, op11_resampling, op12_exact_dedup, op13_merkle

QUERIES = {
    "op1_url_filter": op1_url_filter.op1_url_filter,
    "op2_mixing": op2_mixing.op2_mixing,
    "op3_toxicity": op3_toxicity.op3_toxicity,
    "op4_licenses": op4_licenses.op4_licenses,
    "op5_simhash": op5_simhash.op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup.op6_suffix_dedup,
    "op7_secrets": op7_secrets.op7_secrets,
    "op8_line_dedup": op8_line_dedup.op8_line_dedup,
    "op9_topk": op9_topk.op9_topk,
    "op10_decontamination": op10_decontamination.op10_decontamination,
    "op11_resampling": op11_resampling.op11_resampling,
    "op12_exact_dedup": op12_exact_dedup.op12_exact_dedup,
    "op13_merkle": op13_merkle.op13_merkle,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op2_mixing": op2_mixing.SQL,
    "op6_suffix_dedup": op6_suffix_dedup.SQL,
    "op7_secrets": op7_secrets.SQL,
    "op8_line_dedup": op8_line_dedup.SQL,
    "op9_topk": op9_topk.SQL,
    "op10_decontamination": op10_decontamination.SQL,
    "op11_resampling": op11_resampling.SQL,
    "op12_exact_dedup": op12_exact_dedup.SQL,
    "op13_merkle": op13_merkle.SQL,
}
