"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftmerge.llm import bpe, chat, hmm, middle, packing, privacy, simhash, substring, tiling, toxicity, transport, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat": chat.op2_chat,
    "op3_privacy": privacy.op3_privacy,
    "op4_substring": substring.op4_substring,
    "op5_decontamination": tiling.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_hmm": hmm.op8_hmm,
    "op9_media": transport.op9_media,
    "op10_warc": warc.op10_warc,
    "op11_bpe": bpe.op11_bpe,
    "op12_middle": middle.op12_middle,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.OP2_SQL,
    "op4_substring": substring.OP4_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_middle": middle.OP12_SQL,
}
