"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .embeddings import OP7_SQL, op7_embedding_duplicates
from .fingerprints import op8_fingerprints
from .langid import op9_language_id
from .licenses import OP5_SQL, op5_licenses
from .minhash import OP4_SQL, op4_near_duplicates
from .mixing import op6_mixing
from .sharding import op10_sharding
from .tokencounts import OP1_SQL, op1_token_counts
from .urlfilter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_mixing": op6_mixing,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_fingerprints": op8_fingerprints,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {"op1_token_counts": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_licenses": OP5_SQL, "op7_embedding_duplicates": OP7_SQL}
