"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from tablecare.llm import (
    bpe,
    decontaminate,
    exact,
    idfile,
    jaccard,
    language,
    licenses,
    pages,
    periods,
    quality,
    repeats,
    search,
    toxicity,
)

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_token_files": idfile.op3_token_files,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_suffix_dedup": repeats.op6_suffix_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": language.op8_language_id,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_html_text": pages.op12_html_text,
    "op13_ranked_search": search.op13_ranked_search,
}
ORACLES = {
    "op2_exact_dedup": exact.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "op13_ranked_search": search.SQL,
}
