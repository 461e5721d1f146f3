"""Operators for preparing language-model training data, and their registered queries."""

from .byte_bpe import op10_byte_bpe
from . import exact_dedup
from .exact_dedup import op7_exact_dedup
from .language_id import op8_language_id
from .licenses import op3_license_scan
from .lm_score import op6_lm_score
from . import merkle, spelling
from .merkle import op13_merkle
from .near_dedup import op9_near_dedup
from .packing import op1_packing
from .quality import op4_quality
from .secrets import op5_secret_scan
from .simhash import op11_simhash
from .spelling import op12_spelling
from .urls import op2_url_filter

QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_score": op6_lm_score,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_simhash": op11_simhash,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
