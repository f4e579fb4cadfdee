"""Queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import collocations, hard_negatives, neighbours
from .chat import op6_chat
from .decontaminate import op9_decontamination
from .licenses import op4_licenses
from .media import op7_audio
from .ngram_join import op10_ngram_join
from .packing import op1_packing
from .quality import op3_quality
from .secrets import op8_secrets
from .substrings import op5_substrings
from .token_counts import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_quality, op4_licenses, op5_substrings, op6_chat, op7_audio, op8_secrets, op9_decontamination, op10_ngram_join, hard_negatives.op11_hard_negatives, neighbours.op12_neighbours, collocations.op13_collocations)}

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": hard_negatives.SQL, "op13_collocations": collocations.SQL}
