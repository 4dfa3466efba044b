"""The text operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, coding, collocations, contamination, jaccard, language, licenses, media, packing, quality, suffixes, trie, urls


def queries() -> dict:
    return {
        "op1_token_file": coding.op1_token_file,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_decontamination": contamination.op3_decontamination,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_url_filter": urls.op5_url_filter,
        "op6_media_chunks": media.op6_media_chunks,
        "op7_language": language.op7_language,
        "op8_packing": packing.op8_packing,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_quality": quality.op10_quality,
        "op11_bpe": bpe.op11_bpe,
        "op12_collocations": collocations.op12_collocations,
        "op13_conversation_trie": trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.SQL, "op12_collocations": collocations.SQL, "op13_conversation_trie": trie.SQL}
