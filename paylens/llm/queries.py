"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paylens.llm.common import table
from paylens.llm.decontaminate import op7_decontaminate
from paylens.llm.html_text import op11_html_text
from paylens.llm.language import op5_language
from paylens.llm.licenses import op2_license_scan
from paylens.llm.mixing import op3_mix_sources
from paylens.llm.near_dup import op10_near_dup
from paylens.llm.oracle import ORACLE_SQL  # noqa: F401
from paylens.llm.periodic_runs import op12_periodic_runs
from paylens.llm.pii import op4_pii
from paylens.llm.quality import op1_quality
from paylens.llm.secrets import op6_secret_scan
from paylens.llm.spelling import op13_spelling
from paylens.llm.substring_dedup import op8_substring_dedup
from paylens.llm.vector_search import op9_vector_search

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality": lambda s, d: op1_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op2_license_scan": lambda s, d: op2_license_scan(table(s, d, "documents")),
    "op3_mix_sources": lambda s, d: op3_mix_sources(table(s, d, "documents")),
    "op4_pii": lambda s, d: op4_pii(table(s, d, "documents")),
    "op5_language": lambda s, d: op5_language(table(s, d, "pages"), table(s, d, "documents")),
    "op6_secret_scan": lambda s, d: op6_secret_scan(table(s, d, "documents")),
    "op7_decontaminate": lambda s, d: op7_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_substring_dedup": lambda s, d: op8_substring_dedup(table(s, d, "documents")),
    "op9_vector_search": lambda s, d: op9_vector_search(table(s, d, "embeddings")),
    "op10_near_dup": lambda s, d: op10_near_dup(table(s, d, "documents")),
    "op11_html_text": lambda s, d: op11_html_text(table(s, d, "pages")),
    "op12_periodic_runs": lambda s, d: op12_periodic_runs(table(s, d, "documents")),
    "op13_spelling": lambda s, d: op13_spelling(table(s, d, "documents")),
}
