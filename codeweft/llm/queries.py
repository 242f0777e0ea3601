"""The queries and SQL that ``__spark_entry__`` adds for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup
from .byte_bpe import op5_byte_bpe
from .chat import op7_chat
from .decontaminate import op8_decontaminate
from .html_text import op9_html_text
from .lm import op10_lm_score
from .quality import op6_quality
from .simhash import op4_simhash
from .token_files import op1_token_files
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_text": op9_html_text,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL}
