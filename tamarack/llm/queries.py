"""The operators' queries, by name; SQL where SQL can express them."""

from __future__ import annotations

from .bpe_codec import op5_bpe_codec
from .decontaminate import op3_decontaminate
from .fingerprint import op10_fingerprint
from .html_extraction import op11_html_extraction
from .language_id import op1_language_id
from .license_scan import op9_license_scan
from .oracle import ORACLES
from .prefix_trie import op12_prefix_trie
from .quality import op8_quality
from .secrets import op7_secrets
from .simhash import op6_simhash
from .token_counts import op4_token_counts
from .warc import op2_warc
from .whitening import op13_whitening

_OPERATORS = (
    op1_language_id, op2_warc, op3_decontaminate, op4_token_counts, op5_bpe_codec, op6_simhash, op7_secrets, op8_quality, op9_license_scan, op10_fingerprint,
    op11_html_extraction, op12_prefix_trie, op13_whitening,
)
QUERIES = {f.__name__: f for f in _OPERATORS}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
