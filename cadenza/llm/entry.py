"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .decontamination import op6_benchmark_decontamination
from .language_id import op9_language_id
from .license_scan import op10_license_scan
from .minhash import op8_minhash_near_dedup
from .mixing import op7_mixing
from .quality_rules import op2_quality_rules
from .sharding import op5_sharding
from .substring_dedup import op1_substring_dedup
from .toxicity import op4_toxicity
from .warc import op3_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_warc,
        op4_toxicity,
        op5_sharding,
        op6_benchmark_decontamination,
        op7_mixing,
        op8_minhash_near_dedup,
        op9_language_id,
        op10_license_scan,
    )
}
ORACLES: dict[str, str] = oracles.SQL
