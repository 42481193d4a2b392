"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .avimedia import op4_avi_mjpeg
from .bestfit import op6_best_fit_packing
from .bpe import op5_byte_bpe
from .bytecnn import op1_byte_cnn_language
from .convrepair import op11_conversation_repair
from .hilbert import op2_hilbert_shards
from .oph import op8_oph_minhash
from .periodic import op12_periodic_runs
from .pii import op13_personal_data
from .simhash import op10_simhash_near_dedup
from .subword import op7_subword_quality
from .urls import OP9_SQL, op9_url_filter
from .zframes import op3_zstd_frames

QUERIES = {
    "op1_byte_cnn_language": op1_byte_cnn_language,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_zstd_frames": op3_zstd_frames,
    "op4_avi_mjpeg": op4_avi_mjpeg,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_subword_quality": op7_subword_quality,
    "op8_oph_minhash": op8_oph_minhash,
    "op9_url_filter": op9_url_filter,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}
ORACLE_SQL = {"op9_url_filter": OP9_SQL}
