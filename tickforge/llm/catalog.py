"""Queries of the corpus operators, each over its whole table, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import op01_token_files, op02_quality, op03_media, op04_winnowing, op05_simhash, op06_line_dedup, op07_packing, op08_lattice_lm, op09_mixing, op10_token_counts, op11_language_id, op12_prefix_trie, op13_whitening

QUERIES = {
    "op1_token_files": op01_token_files.query,
    "op2_quality": op02_quality.query,
    "op3_media": op03_media.query,
    "op4_winnowing": op04_winnowing.query,
    "op5_simhash": op05_simhash.query,
    "op6_line_dedup": op06_line_dedup.query,
    "op7_packing": op07_packing.query,
    "op8_lattice_lm": op08_lattice_lm.query,
    "op9_mixing": op09_mixing.query,
    "op10_token_counts": op10_token_counts.query,
    "op11_language_id": op11_language_id.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_whitening": op13_whitening.query,
}
ORACLE = {
    "op6_line_dedup": op06_line_dedup.ORACLE,
}
