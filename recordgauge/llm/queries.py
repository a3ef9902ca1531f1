"""The opN_ queries and the pipeline over the driver's tables, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from recordgauge.llm import bpe, chat_format, decontaminate, html_text, line_dedup, media, minhash, pii, pipeline, quality, url_filter
from recordgauge.session import table


def queries() -> dict:
    return {
        "op1_html_text": lambda s, d: html_text.op1(table(s, d, "pages")),
        "op2_contextual_pii": lambda s, d: pii.op2(table(s, d, "documents")),
        "op3_compression_quality": lambda s, d: quality.op3(table(s, d, "documents"), table(s, d, "labels")),
        "op4_line_dedup": lambda s, d: line_dedup.op4(table(s, d, "documents")),
        "op5_media": lambda s, d: media.op5(table(s, d, "documents")),
        "op6_minhash_dedup": lambda s, d: minhash.op6(table(s, d, "documents")),
        "op7_byte_bpe": lambda s, d: bpe.op7(table(s, d, "documents")),
        "op8_decontamination": lambda s, d: decontaminate.op8(table(s, d, "documents"), table(s, d, "benchmark")),
        "op9_chat_format": lambda s, d: chat_format.op9(table(s, d, "conversations")),
        "op10_url_filter": lambda s, d: url_filter.op10(table(s, d, "pages")),
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op6_minhash_dedup": minhash.OP6_SQL, "op9_chat_format": chat_format.OP9_SQL}
