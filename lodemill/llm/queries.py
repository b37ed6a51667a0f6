"""The queries of this subpackage, by name, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from . import bpe, decontaminate, fill_in_middle, hard_negatives, line_dedup, pieces, quality, simhash, sketch, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_quality": quality.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_fingerprints": sketch.query,
    "op5_toxicity": toxicity.query,
    "op6_simhash": simhash.query,
    "op7_decontamination": decontaminate.query,
    "op8_byte_bpe": bpe.query,
    "op9_warc_revisits": warc.query,
    "op10_line_dedup": line_dedup.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_pieces": pieces.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op1_url_filters": url_filter.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
