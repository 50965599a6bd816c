"""Registered queries of this subpackage: name -> query, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from spanloom.llm import manifest, secrets
from spanloom.llm.align import op11_tokenizer_alignment
from spanloom.llm.ann import op5_nearest_neighbours
from spanloom.llm.bpe import op9_byte_bpe
from spanloom.llm.lm import op7_lm_scoring
from spanloom.llm.manifest import op13_merkle_manifest
from spanloom.llm.media import op6_media_columns
from spanloom.llm.mixing import op10_mixing_sources
from spanloom.llm.ngram_join import op4_ngram_jaccard_join
from spanloom.llm.pack import op12_best_fit_packing
from spanloom.llm.pii import op2_pii
from spanloom.llm.secrets import op1_secret_scans
from spanloom.llm.store import op8_content_store
from spanloom.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_media_columns": op6_media_columns,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_content_store": op8_content_store,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing_sources": op10_mixing_sources,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op1_secret_scans": secrets.ORACLE, "op13_merkle_manifest": manifest.ORACLE}
