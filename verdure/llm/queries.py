"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .op1_hmm import op1_hmm_score
from .op2_rlz import OP2_SQL, op2_substring_dedup
from .op3_pii import op3_personal_data
from .op4_omh import op4_near_duplicates
from .op10_crf import op10_quality
from .op11_phrases import OP11_SQL, op11_phrase_collocations
from .op12_tokens import op12_token_counts
from .op13_crc import OP13_SQL, op13_importance_sample
from .op5_warc import OP5_SQL, op5_warc_round_trip
from .op6_urls import OP6_SQL, op6_url_filter
from .op7_rabitq import OP7_SQL, op7_nearest
from .op8_curriculum import OP8_SQL, op8_curriculum_mix
from .op9_decontam import op9_benchmark_leaks


def queries() -> dict:
    return {f.__name__: f for f in (op1_hmm_score, op2_substring_dedup, op3_personal_data, op4_near_duplicates, op5_warc_round_trip, op6_url_filter, op7_nearest, op8_curriculum_mix, op9_benchmark_leaks, op10_quality, op11_phrase_collocations, op12_token_counts, op13_importance_sample)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op5_warc_round_trip": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_nearest": OP7_SQL, "op8_curriculum_mix": OP8_SQL, "op11_phrase_collocations": OP11_SQL, "op13_importance_sample": OP13_SQL}
