"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import chat, decontaminate, frames, html, licenses, lines, packing, pii, quality, simhash

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_pii_spans": pii.query,
    "op3_line_dedup": lines.query,
    "op4_quality_outliers": quality.query,
    "op5_token_frames": frames.query,
    "op6_simhash_groups": simhash.query,
    "op7_decontaminate": decontaminate.query,
    "op8_preference_format": chat.query,
    "op9_main_text": html.query,
    "op10_pack_sequences": packing.query,
}
ORACLE_SQL = {
    "op3_line_dedup": lines.ORACLE,
    "op4_quality_outliers": quality.oracle(),
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_preference_format": chat.ORACLE,
}
