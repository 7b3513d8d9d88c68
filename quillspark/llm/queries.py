"""The corpus operators' queries and, where SQL can express them, their DuckDB oracles."""

from quillspark.llm import alignment, bpe, collocation, exact_dedup, jaccard, language, media, minhash, packing, quality, substring, suffix, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_suffix_array": suffix.op6_suffix_array,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_gif_media": media.op9_gif_media,
    "op10_language_id": language.op10_language_id,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_phrase_collocation": collocation.op12_phrase_collocation,
    "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op5_warc": warc.SQL, "op11_minhash_near_dedup": minhash.SQL, "op12_phrase_collocation": collocation.SQL}
