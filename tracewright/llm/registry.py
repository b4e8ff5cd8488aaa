"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import chat_format, decontaminate, fill_middle, html_extract, kmeans_tree, lm_score, mil_quality, mixing, ngram_join, quality_rules, secrets, suffix_dedup, whitening

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_poisson_mixing": mixing.op6_poisson_mixing,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_mil": mil_quality.op9_quality_mil,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_kmeans_tree": kmeans_tree.op12_kmeans_tree,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_poisson_mixing": mixing.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}
