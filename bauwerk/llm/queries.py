"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bytebpe import op10_byte_bpe
from .compression import op4_compression_quality
from .crf import op5_crf_toxicity
from .jaccard import OP2_SQL, op2_ngram_jaccard
from .lattice import op8_lattice_score
from .licences import op11_licence_scan
from .linededup import OP3_SQL, op3_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import op1_mixing
from .neardup import OP9_SQL, op9_embedding_near_dup
from .postings import op7_posting_lists
from .resample import OP12_SQL, op12_importance_resampling
from .secrets import op6_secret_scan

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_compression_quality": op4_compression_quality,
    "op5_crf_toxicity": op5_crf_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_posting_lists": op7_posting_lists,
    "op8_lattice_score": op8_lattice_score,
    "op9_embedding_near_dup": op9_embedding_near_dup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_licence_scan": op11_licence_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {"op2_ngram_jaccard": OP2_SQL, "op3_line_dedup": OP3_SQL, "op9_embedding_near_dup": OP9_SQL, "op12_importance_resampling": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
