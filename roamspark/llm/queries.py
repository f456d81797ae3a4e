"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import compaction, decontaminate, dedup, language, minhash, packing, quality, scoring, toxicity, warc


def queries() -> dict:
    return {
        "op1_dedup": dedup.op1_dedup,
        "op2_score": scoring.op2_score,
        "op3_packing": packing.op3_packing,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_compaction": compaction.op6_compaction,
        "op7_warc": warc.op7_warc,
        "op8_language": language.op8_language,
        "op9_minhash": minhash.op9_minhash,
        "op10_quality": quality.op10_quality,
        "score_base": scoring.score_base,
        "warc_records": warc.warc_records,
        "quality_base": quality.quality_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_dedup": dedup.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op6_compaction": compaction.ORACLE,
        "warc_records": warc.ORACLE,
        "score_base": scoring.BASE_ORACLE,
        "quality_base": quality.BASE_ORACLE,
    }
