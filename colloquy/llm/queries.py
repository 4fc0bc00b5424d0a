"""The subpackage's queries, and the SQL of those that SQL can express."""

from colloquy.llm import decontaminate, html_text, jaccard_join, mixing, substring_dedup, topk, toxicity, url_filter, warc, weak_labels

QUERIES = {
    "op10_quality": weak_labels.op10_quality,
    "op9_html_text": html_text.op9_html_text,
    "op6_topk": topk.op6_topk,
    "op5_url_filter": url_filter.op5_url_filter,
    "op8_warc": warc.op8_warc,
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
}

ORACLE_SQL = {
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_topk": topk.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
}
