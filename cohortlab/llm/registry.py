"""The training-data queries and their DuckDB SQL (where SQL can say it)."""

from __future__ import annotations

from .attention_lm import op11_attention_lm
from .byte_bpe import op9_byte_bpe
from .centroids import OP12_SQL, op12_centroids
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP3_SQL, op3_source_mix
from .near_dedup import op7_near_dedup
from .nearest import op1_nearest
from .phrases import OP13_SQL, op13_phrases
from .secrets import OP5_SQL, op5_secret_scan
from .simhash import op4_simhash
from .token_files import op6_token_files
from .toxicity import op8_toxicity
from .warc import OP10_SQL, op10_warc_roundtrip

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_line_dedup": op2_line_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_files": op6_token_files,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc_roundtrip": op10_warc_roundtrip,
    "op11_attention_lm": op11_attention_lm,
    "op12_centroids": op12_centroids,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op3_source_mix": OP3_SQL,
    "op5_secret_scan": OP5_SQL,
    "op10_warc_roundtrip": OP10_SQL,
    "op12_centroids": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
