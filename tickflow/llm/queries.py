"""Registered queries of the subpackage, and the DuckDB SQL of those that SQL can express."""

from tickflow.llm import (
    op1_fingerprint,
    op2_substring,
    op3_bpe,
    op4_records,
    op5_minhash,
    op6_language,
    op7_html,
    op8_warc,
    op9_templates,
    op10_contamination,
    op11_merkle,
    op12_align,
    op13_chat,
)

QUERIES = {
    "op1_fingerprint": op1_fingerprint.query,
    "op2_substring": op2_substring.query,
    "op3_bpe": op3_bpe.query,
    "op4_records": op4_records.query,
    "op5_minhash": op5_minhash.query,
    "op6_language": op6_language.query,
    "op7_html": op7_html.query,
    "op8_warc": op8_warc.query,
    "op9_templates": op9_templates.query,
    "op10_contamination": op10_contamination.query,
    "op11_merkle": op11_merkle.query,
    "op12_align": op12_align.query,
    "op13_chat": op13_chat.query,
}

SQL = {
    "op5_minhash": op5_minhash.SQL,
    "op8_warc": op8_warc.SQL,
    "op10_contamination": op10_contamination.SQL,
    "op11_merkle": op11_merkle.SQL,
}
