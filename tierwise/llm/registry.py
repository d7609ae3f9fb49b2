"""Queries of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (alignment, chat, decontaminate, infill, language, licences, mixing, neardup, packing, quality, rollups, topk,
               warc)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_rollup": rollups.op4_rollup,
    "op5_mixing": mixing.op5_mixing,
    "op6_language": language.op6_language,
    "op7_chat": chat.op7_chat,
    "op8_packing": packing.op8_packing,
    "op9_neardup": neardup.op9_neardup,
    "op10_licences": licences.op10_licences,
    "op11_topk": topk.op11_topk,
    "op12_infill": infill.op12_infill,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op1_quality": quality.oracle(), "op4_rollup": rollups.oracle(), "op7_chat": chat.oracle(),
           "op11_topk": topk.oracle(), "op12_infill": infill.oracle()}
