"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mojiweave.llm.alignment import op11_alignment
from mojiweave.llm.chat import op1_chat
from mojiweave.llm.decontamination import OP10_SQL, op10_decontamination
from mojiweave.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from mojiweave.llm.line_dedup import op5_line_dedup
from mojiweave.llm.mixing import OP13_SQL, op13_mixing
from mojiweave.llm.near_dup import op9_minhash
from mojiweave.llm.packing import op4_packing
from mojiweave.llm.quality_knn import op7_quality_knn
from mojiweave.llm.quality_rules import op2_quality_rules
from mojiweave.llm.substring_dedup import op8_substring_dedup
from mojiweave.llm.toxicity import op6_toxicity
from mojiweave.llm.warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_knn": op7_quality_knn,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_minhash": op9_minhash,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_mixing": op13_mixing,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op10_decontamination": OP10_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_mixing": OP13_SQL,
}
