"""Registered queries of the subpackage, each with its DuckDB counterpart or None."""

from venuedir.llm import (
    dialogues,
    divergence,
    lines,
    media,
    minhash,
    mixing,
    pieces,
    private,
    quality,
    suffix,
    token_files,
    vectors,
    warc,
)

QUERIES = {
    "op3_pieces": (pieces.op3_pieces, None),
    "op4_private": (private.op4_private, None),
    "op2_vector_graph": (vectors.op2_vector_graph, None),
    "op1_suffix_array": (suffix.op1_suffix_array, None),
    "op6_minhash": (minhash.op6_minhash, None),
    "op9_quality": (quality.op9_quality, None),
    "op5_token_files": (token_files.op5_token_files, None),
    "op7_media": (media.op7_media, None),
    "op8_line_dedup": (lines.op8_line_dedup, lines.SQL),
    "op10_mixing": (mixing.op10_mixing, mixing.SQL),
    "op11_warc": (warc.op11_warc, warc.SQL),
    "op12_divergence": (divergence.op12_divergence, divergence.SQL),
    "op13_dialogues": (dialogues.op13_dialogues, None),
}
