"""Queries of this subpackage and their SQL."""

from linework.llm import bpe, collocations, decontaminate, exact_dedup, katz, langid, ngram_join, quality, quotes, simhash, token_counts, url_filter, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_language_id": langid.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_quotation_linking": quotes.op5_quotation_linking,
    "quoted_replies": quotes.quoted_replies,
    "op6_katz": katz.op6_katz,
    "op7_token_counts": token_counts.op7_token_counts,
    "token_counts_patterns": token_counts.token_counts_patterns,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_whitening": whitening.op11_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
ORACLES = {
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_quotation_linking": quotes.OP5_SQL,
    "quoted_replies": quotes.QUOTED_SQL,
    "token_counts_patterns": token_counts.PATTERNS_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
