"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from sparkmat.llm import bpe, chat, decontam, htmltext, linededup, neardup, neighbours, quality, repair, subword, toxicity, trie, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_html_text": htmltext.op5_html_text,
    "op6_quality_classifier": subword.op6_quality_classifier,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_chat": chat.op10_chat,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_embedding_duplicates": neighbours.op12_embedding_duplicates,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.OP3_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_embedding_duplicates": neighbours.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
