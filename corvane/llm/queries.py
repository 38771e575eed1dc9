"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.ann import op10_ann
from corvane.llm.exact_search import OP3_SQL, op3_exact_top_k
from corvane.llm.language import op4_language
from corvane.llm.mixing import op7_mixing
from corvane.llm.pieces import op2_sentencepiece
from corvane.llm.ppm import op1_ppm
from corvane.llm.simhash import op8_simhash
from corvane.llm.substring import OP5_SQL, op5_substring
from corvane.llm.token_files import op9_token_files
from corvane.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": op1_ppm,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_language": op4_language,
    "op5_substring": op5_substring,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_ann": op10_ann,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": OP3_SQL,
    "op5_substring": OP5_SQL,
}
