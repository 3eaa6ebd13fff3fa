"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embeddings, language, lines, media, mixing, neardup, packing, pii, toxicity, urls


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_mixing": mixing.query,
        "op3_url_filter": urls.query,
        "op4_language_id": language.query,
        "op5_media": media.query,
        "op6_pii": pii.query,
        "op7_minhash_dedup": neardup.query,
        "op8_line_dedup": lines.query,
        "op9_packing": packing.query,
        "op10_embedding_dedup": embeddings.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE,
        "op3_url_filter": urls.ORACLE,
        "op7_minhash_dedup": neardup.ORACLE,
        "op8_line_dedup": lines.ORACLE,
        "op10_embedding_dedup": embeddings.ORACLE,
    }
