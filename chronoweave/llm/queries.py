"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from chronoweave.llm.decontaminate import op9_benchmark_decontamination
from chronoweave.llm import collocations, conversations, decontaminate, linededup, quality, substring
from chronoweave.llm.collocations import op11_spam_collocations
from chronoweave.llm.conversations import op13_earley_conversation_repair
from chronoweave.llm.html import op5_site_style_tree_html
from chronoweave.llm.linededup import op10_winnowed_line_dedup
from chronoweave.llm.mixing import op4_systematic_mixing
from chronoweave.llm.pii import op6_information_theoretic_pii
from chronoweave.llm.quality import op7_quality_rules
from chronoweave.llm.rules import op12_rule_ensemble_quality
from chronoweave.llm.sharding import op2_rendezvous_sharding
from chronoweave.llm.simhash import op8_simhash_near_dedup
from chronoweave.llm.substring import op3_suffix_tree_substring_dedup
from chronoweave.llm.toxicity import op1_kneser_ney_toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_kneser_ney_toxicity, op2_rendezvous_sharding, op3_suffix_tree_substring_dedup, op4_systematic_mixing, op5_site_style_tree_html, op6_information_theoretic_pii, op7_quality_rules, op8_simhash_near_dedup, op9_benchmark_decontamination, op10_winnowed_line_dedup, op11_spam_collocations, op12_rule_ensemble_quality, op13_earley_conversation_repair)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_tree_substring_dedup": substring.ORACLE_SQL,
        "op7_quality_rules": quality.ORACLE_SQL,
        "op9_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op10_winnowed_line_dedup": linededup.ORACLE_SQL,
        "op11_spam_collocations": collocations.ORACLE_SQL,
        "op13_earley_conversation_repair": conversations.ORACLE_SQL,
    }
