"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from farelake.llm import (decontaminate, exact_dedup, fill_middle, html_text, lexical_search, licences, mixing, near_dedup, quality, sharding,
                          suffix_dedup, toxicity, url_filter)

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality": quality.query,
    "op3_toxicity": toxicity.query,
    "op4_url_filter": url_filter.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_licences": licences.query,
    "op7_shards": sharding.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_decontaminate": decontaminate.query,
    "op10_near_dedup": near_dedup.query,
    "op11_fill_middle": fill_middle.query,
    "op12_html_text": html_text.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
