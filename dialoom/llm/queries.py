"""The corpus operators' registered queries and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import warc
from dialoom.llm.bpe import op13_bpe_coding
from dialoom.llm.decontaminate import op10_decontaminate
from dialoom.llm.extract import op3_html_extract
from dialoom.llm.licenses import op8_license_scan
from dialoom.llm.linedup import op4_line_dedup
from dialoom.llm.lm import op5_lm_score
from dialoom.llm.media import op7_media_columns
from dialoom.llm.packing import op9_packing
from dialoom.llm.periodic import op12_periodic_runs
from dialoom.llm.simhash import op2_simhash
from dialoom.llm.toxicity import op1_toxicity
from dialoom.llm.vectorcodes import op11_vector_codes
from dialoom.llm.vectorcodes import oracle as op11_oracle
from dialoom.llm.warc import op6_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_line_dedup": op4_line_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_media_columns": op7_media_columns,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bpe_coding": op13_bpe_coding,
}

ORACLES: dict[str, str] = {"op6_warc_salvage": warc.ORACLE, "op11_vector_codes": op11_oracle()}
