"""Queries and SQL of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from .op1_langid import op1_langid
from .op2_media import op2_media
from .op3_sharding import op3_sharding
from .op4_mix import op4_mix
from .op5_bpe import op5_bpe
from .op6_toxicity import op6_toxicity
from .op7_pii import op7_pii
from .op8_spotsigs import op8_spotsigs
from .op9_neardup import op9_neardup
from .op10_lm import op10_lm
from .oracles import ORACLE_SQL  # noqa: F401

QUERIES = {f.__name__: f for f in (op1_langid, op2_media, op3_sharding, op4_mix, op5_bpe, op6_toxicity, op7_pii, op8_spotsigs, op9_neardup, op10_lm)}
