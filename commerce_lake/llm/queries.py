"""The queries of the training-data operators, by name."""

from __future__ import annotations

from . import op1_decontamination as op1
from . import op10_warc as op10
from . import op11_minhash_dedup as op11
from . import op12_merkle_manifest as op12
from . import op13_centroid_clustering as op13
from . import op2_html_extraction as op2
from . import op3_lm_scoring as op3
from . import op4_language_id as op4
from . import op5_jaccard_join as op5
from . import op6_mixing as op6
from . import op7_exact_topk as op7
from . import op8_substring_dedup as op8
from . import op9_token_output as op9

QUERIES = {
    "op1_decontamination": op1.op1_decontamination,
    "op2_html_extraction": op2.op2_html_extraction,
    "op3_lm_scoring": op3.op3_lm_scoring,
    "op4_language_id": op4.op4_language_id,
    "op5_jaccard_join": op5.op5_jaccard_join,
    "op6_mixing": op6.op6_mixing,
    "op7_exact_topk": op7.op7_exact_topk,
    "op8_substring_dedup": op8.op8_substring_dedup,
    "op9_token_output": op9.op9_token_output,
    "op10_warc": op10.op10_warc,
    "op11_minhash_dedup": op11.op11_minhash_dedup,
    "op12_merkle_manifest": op12.op12_merkle_manifest,
    "op13_centroid_clustering": op13.op13_centroid_clustering,
}

#: DuckDB SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op6_mixing": op6.ORACLE_SQL, "op7_exact_topk": op7.ORACLE_SQL, "op12_merkle_manifest": op12.ORACLE_SQL, "op13_centroid_clustering": op13.ORACLE_SQL}
