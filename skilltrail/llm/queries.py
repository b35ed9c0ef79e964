"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skilltrail.llm.decontamination import op10_decontamination
from skilltrail.llm.fingerprints import op11_fingerprints
from skilltrail.llm.html_text import op3_html_text
from skilltrail.llm.language_id import op4_language_id
from skilltrail.llm.near_dup import op8_near_dup
from skilltrail.llm.packing import op2_packing
from skilltrail.llm.quality_model import op5_quality_model
from skilltrail.llm.quality_rules import OP7_SQL, op7_quality_rules
from skilltrail.llm.sharding import op1_sharding
from skilltrail.llm.token_files import op6_token_files
from skilltrail.llm.tokens import small_batches
from skilltrail.llm.url_filter import op9_url_filter
from skilltrail.llm.vector_codes import OP12_SQL, op12_vector_codes
from skilltrail.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; each takes `(spark, sf_dir)`."""

    def bound(query):
        return lambda spark, sf_dir: query(small_batches(spark), sf_dir)

    return {name: bound(query) for name, query in QUERIES.items()}


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_quality_model": op5_quality_model,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dup": op8_near_dup,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_fingerprints": op11_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query that SQL can express."""
    return {
        "op7_quality_rules": OP7_SQL,
        "op12_vector_codes": OP12_SQL,
    }
