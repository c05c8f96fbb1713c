"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from . import chat, exact_dedup, fim, resampling, warc
from .decontaminate import op7_decontamination
from .langid import op9_language_id
from .licenses import op3_license_scan
from .near_dedup import op5_near_dedup
from .packing import op6_best_fit_packing
from .pii import op8_pii
from .quality import op4_quality
from .token_output import op1_token_output

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_near_dedup": op5_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_chat_format": chat.op10_chat_format,
    "op11_resampling": resampling.op11_resampling,
    "op12_warc": warc.op12_warc,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
