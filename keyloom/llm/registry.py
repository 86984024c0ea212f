"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from keyloom.llm import decontaminate, jaccard_join, line_dedup, mixing, url_filter
from keyloom.llm.hmm_lm import op1_hmm_lm
from keyloom.llm.language_id import op2_language_id
from keyloom.llm.license_scan import op7_license_scan
from keyloom.llm.quality_rules import op5_quality_rules
from keyloom.llm.secret_scan import op10_secret_scan

QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_lm, op2_language_id, mixing.op3_mix_sources, line_dedup.op4_line_dedup, op5_quality_rules, decontaminate.op6_decontaminate,
        op7_license_scan, url_filter.op8_url_filter, jaccard_join.op9_jaccard_join, op10_secret_scan,
    )
}

ORACLES = {
    "op3_mix_sources": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
