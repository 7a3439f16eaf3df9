"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP11_SQL, op11_centroids
from .decontaminate import OP5_SQL, op5_decontamination
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op8_html_text
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op3_near_dedup
from .quality import op4_quality
from .sharding import op7_sharding
from .simhash_dedup import op12_simhash
from .substring_dedup import op6_substring_dedup
from .warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_mixing, op3_near_dedup, op4_quality, op5_decontamination, op6_substring_dedup, op7_sharding, op8_html_text, op9_line_dedup, op10_exact_dedup, op11_centroids, op12_simhash, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_mixing": OP2_SQL, "op5_decontamination": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_centroids": OP11_SQL, "op13_filter_audit": OP13_SQL}
