"""The corpus operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, compaction, decontam, lines, mixing, pages, pii, quality, secrets, similar, sketches, trie, urls

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_personal_data": pii.op4_personal_data,
    "op5_fingerprints": sketches.op5_fingerprints,
    "op6_jaccard_join": similar.op6_jaccard_join,
    "op7_main_text": pages.op7_main_text,
    "op8_bpe": bpe.op8_bpe,
    "op9_url_filter": urls.op9_url_filter,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_compaction": compaction.op11_compaction,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_source_mix": mixing.op13_source_mix,
}
SQL = {
    "op2_line_dedup": lines.OP2_SQL,
    "op6_jaccard_join": similar.OP6_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_source_mix": mixing.OP13_SQL,
}
