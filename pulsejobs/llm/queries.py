"""The queries of this subpackage and their SQL, by the names of the entry module."""

from . import decontamination, langid, media, mixing, neardup, pieces, pseudonyms, quality, repeats, sharding, variants, warc, whitening

QUERIES = {
    "op1_rake_and_sample": mixing.op1_rake_and_sample,
    "op2_chosen_path": neardup.op2_chosen_path,
    "op3_warc_chunks": warc.op3_warc_chunks,
    "op4_feistel_pseudonyms": pseudonyms.op4_feistel_pseudonyms,
    "op5_text_png": media.op5_text_png,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op7_run_length_index": repeats.op7_run_length_index,
    "op8_quality_crf": quality.op8_quality_crf,
    "op9_decontaminate": decontamination.op9_decontaminate,
    "op10_byte_cnn": langid.op10_byte_cnn,
    "op11_whitening": whitening.op11_whitening,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

ORACLE = {
    "op1_rake_and_sample": mixing.OP1_SQL,
    "op2_chosen_path": neardup.OP2_SQL,
    "op3_warc_chunks": warc.OP3_SQL,
    "op6_byte_shards": sharding.OP6_SQL,
    "op7_run_length_index": repeats.OP7_SQL,
    "op9_decontaminate": decontamination.OP9_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
}
