"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bpe import op10_bpe
from .chat import OP7_SQL, op7_chat
from .codes import OP11_SQL, op11_codes
from .decontaminate import op9_decontaminate
from .language import op4_language
from .neighbours import op3_neighbours
from .quality import op8_quality
from .repeats import OP6_SQL, op6_repeats
from .scoring import op12_scoring
from .secrets import OP1_SQL, op1_secrets
from .simhash import op2_simhash
from .toxicity import op5_toxicity
from .whitening import op13_whitening


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_simhash": op2_simhash,
        "op3_neighbours": op3_neighbours,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_repeats": op6_repeats,
        "op7_chat": op7_chat,
        "op8_quality": op8_quality,
        "op9_decontaminate": op9_decontaminate,
        "op10_bpe": op10_bpe,
        "op11_codes": op11_codes,
        "op12_scoring": op12_scoring,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": OP1_SQL,
        "op6_repeats": OP6_SQL,
        "op7_chat": OP7_SQL,
        "op11_codes": OP11_SQL,
    }
