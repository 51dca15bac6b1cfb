"""Queries of this subpackage and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from recallforge.llm.decontaminate import OP8_SQL, op8_winnowing
from recallforge.llm.line_dedup import OP6_SQL, op6_site_spread
from recallforge.llm.mixing import op10_pfair
from recallforge.llm.near_dedup import op3_multi_index_hamming
from recallforge.llm.license_scan import OP13_SQL, op13_rare_token_index
from recallforge.llm.prefix_trie import op11_partial_tries
from recallforge.llm.quality_classifier import op1_quadratic_discriminant
from recallforge.llm.quality_rules import op2_decision_list
from recallforge.llm.secrets import op9_blob_ledger
from recallforge.llm.sharding import op4_label_propagation
from recallforge.llm.structure_repair import op12_cost_to_go
from recallforge.llm.substring_dedup import op7_paragraph_bands
from recallforge.llm.suffix_dedup import op5_difference_cover


def queries():
    return {f.__name__: f for f in (op1_quadratic_discriminant, op2_decision_list, op3_multi_index_hamming, op4_label_propagation, op5_difference_cover, op6_site_spread, op7_paragraph_bands, op8_winnowing, op9_blob_ledger, op10_pfair, op11_partial_tries, op12_cost_to_go, op13_rare_token_index)} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op6_site_spread": OP6_SQL, "op8_winnowing": OP8_SQL, "op13_rare_token_index": OP13_SQL}
