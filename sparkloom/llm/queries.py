"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import secrets, winnowing
from sparkloom.llm.audio import op7_chroma
from sparkloom.llm.langid import op5_language
from sparkloom.llm.licenses import op10_licenses
from sparkloom.llm.mixing import op6_mixing
from sparkloom.llm.quality import op9_quality
from sparkloom.llm.sharding import op8_sharding
from sparkloom.llm.simhash import op2_simhash
from sparkloom.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_decontamination": winnowing.op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_chroma": op7_chroma,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op1_secrets": secrets.ORACLE,
    "op3_decontamination": winnowing.ORACLE,
}
