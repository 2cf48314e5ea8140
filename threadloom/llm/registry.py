"""The queries opN_* and the SQL of those that DuckDB can express."""

from . import bpe, htmltext, idfiles, langid, matroska, mixing, neighbours, simhash, suffixdedup, tokencount

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_html_text": htmltext.op2_html_text,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_media_columns": matroska.op4_media_columns,
    "op5_simhash_groups": simhash.op5_simhash_groups,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_suffix_repeats": suffixdedup.op8_suffix_repeats,
    "op9_token_id_files": idfiles.op9_token_id_files,
    "op10_bpe_encode_decode": bpe.op10_bpe_encode_decode,
}
ORACLE_SQL = {
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_nearest_neighbours": neighbours.OP7_SQL,
}
