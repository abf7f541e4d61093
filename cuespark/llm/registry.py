"""Queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .exact_dedup import SQL as EXACT_DEDUP_SQL
from .exact_dedup import op4_exact_dedup
from .html_extraction import op9_html_extraction
from .jaccard_join import SQL as JACCARD_SQL
from .jaccard_join import op7_jaccard_join
from .license_scan import op5_license_scan
from .license_scan import sql as license_sql
from .packing import op2_packing
from .phrase_index import SQL as DECONTAMINATION_SQL
from .phrase_index import op12_decontamination
from .quality_rules import op10_quality_rules
from .sharding import op1_sharding
from .source_audit import SQL as SOURCE_AUDIT_SQL
from .source_audit import op13_source_audit
from .substring_dedup import op8_suffix_dedup
from .token_files import op6_token_files
from .vector_codes import SQL as VECTOR_CODES_SQL
from .vector_codes import op11_vector_codes
from .workspace import prepare

OPERATORS = [op1_sharding, op2_packing, op3_bpe, op4_exact_dedup, op5_license_scan, op6_token_files, op7_jaccard_join, op8_suffix_dedup, op9_html_extraction, op10_quality_rules, op11_vector_codes, op12_decontamination, op13_source_audit]


def _shipped(query):
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_DEDUP_SQL, "op5_license_scan": license_sql(), "op7_jaccard_join": JACCARD_SQL, "op11_vector_codes": VECTOR_CODES_SQL, "op12_decontamination": DECONTAMINATION_SQL, "op13_source_audit": SOURCE_AUDIT_SQL}
