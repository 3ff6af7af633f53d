"""The queries of this package and their SQL."""

from lexiloom.session import ship_package

from . import binary_output, chat, language_id, minhash, multi_index, neighbours, packing, quality, sentencepieces, suffix_dedup

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_minhash": minhash.op2_minhash,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_multi_index": multi_index.op4_multi_index,
    "op5_chat_windows": chat.op5_chat_windows,
    "op6_token_files": binary_output.op6_token_files,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_language_id": language_id.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_packing": packing.op10_packing,
}
SQL = {"op5_chat_windows": chat.OP5_SQL}


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _shipped(query) for name, query in QUERIES.items()}


def oracle_sql():
    return dict(SQL)
