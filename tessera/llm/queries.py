"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_pairs import op4_byte_pairs
from .chain_dedup import op9_chain_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language_id import op10_language_id
from .media import op5_media
from .ngram_join import op2_ngram_join
from .packing import op6_packing
from .quality import op7_quality
from .secrets import OP8_SQL, op8_secret_scan
from .suffix_dedup import op1_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_ngram_join, op3_exact_dedup, op4_byte_pairs, op5_media, op6_packing, op7_quality, op8_secret_scan, op9_chain_dedup, op10_language_id)
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op8_secret_scan": OP8_SQL}
