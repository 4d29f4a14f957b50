"""The numbered queries by name, and the SQL of those that SQL can express."""

from . import byte_bpe, chat_format, chat_repair, collocations, embedding_dedup, language_id, mixing, packing, quality_rules, secret_scan, simhash, substring_dedup, token_store

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        chat_format.op2_chat_format,
        secret_scan.op3_secret_scan,
        quality_rules.op4_quality_rules,
        packing.op5_packing,
        embedding_dedup.op6_embedding_dedup,
        token_store.op7_token_store,
        mixing.op8_mixing,
        simhash.op9_simhash,
        language_id.op10_language_id,
        byte_bpe.op11_byte_bpe,
        collocations.op12_collocations,
        chat_repair.op13_chat_repair,
    )
}

SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_chat_repair": chat_repair.OP13_SQL,
}
