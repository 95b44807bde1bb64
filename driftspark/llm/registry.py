"""Queries of this package and the SQL they must agree with."""

from __future__ import annotations

from driftspark.llm.alignment import op12_alignment
from driftspark.llm.attention import op6_attention
from driftspark.llm.decontaminate import OP10_SQL, op10_decontaminate
from driftspark.llm.html_text import op9_html_text
from driftspark.llm.jaccard import op13_jaccard
from driftspark.llm.licences import op4_licences
from driftspark.llm.mixing import OP2_SQL, op2_mixing
from driftspark.llm.pii import op5_pii
from driftspark.llm.quality_rules import OP1_SQL, op1_quality_rules
from driftspark.llm.repeats import op7_repeats
from driftspark.llm.resampling import op11_resampling
from driftspark.llm.sharding import op8_sharding
from driftspark.llm.simhash import op3_simhash

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_simhash, op4_licences, op5_pii, op6_attention, op7_repeats, op8_sharding,
                                 op9_html_text, op10_decontaminate, op11_resampling, op12_alignment, op13_jaccard)}
ORACLES = {"op1_quality_rules": OP1_SQL, "op2_mixing": OP2_SQL, "op10_decontaminate": OP10_SQL}
