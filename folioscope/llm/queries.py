"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .chat import OP9_SQL, op9_chat_format
from .decontaminate import OP4_SQL, op4_decontaminate
from .html import OP7_SQL, op7_html_extract
from .langid import op6_langid
from .lm import op3_lm_score
from .media import op2_media
from .pieces import op5_sentencepiece
from .sharding import op8_sharding
from .simhash import op10_simhash
from .suffix_dedup import OP1_SQL, op1_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_media, op3_lm_score, op4_decontaminate, op5_sentencepiece, op6_langid, op7_html_extract, op8_sharding, op9_chat_format, op10_simhash]
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op4_decontaminate": OP4_SQL, "op7_html_extract": OP7_SQL, "op9_chat_format": OP9_SQL}
