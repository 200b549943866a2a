"""Registered queries of the corpus operators, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_text import op6_html_text
from .langid import op10_langid
from .near_dedup import op9_near_dedup
from .packing import op8_packing
from .phrases import OP12_SQL, op12_phrases
from .pii import op5_pii
from .quality import op1_quality
from .quality_rules import op3_quality_rules
from .search import OP13_SQL, op13_search
from .toxicity import op7_toxicity
from .warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_langid": op10_langid,
    "op11_warc": op11_warc,
    "op12_phrases": op12_phrases,
    "op13_search": op13_search,
}

SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op11_warc": OP11_SQL, "op12_phrases": OP12_SQL, "op13_search": OP13_SQL}
