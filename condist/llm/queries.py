"""Registered queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from condist.llm.ann import op6_ann
from condist.llm.audio import op9_audio
from condist.llm.bpe import op7_bpe
from condist.llm.chat import OP8_SQL, op8_chat
from condist.llm.clustering import OP13_SQL, op13_clusters
from condist.llm.packing import op1_packing
from condist.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from condist.llm.quality import op2_quality
from condist.llm.simhash import op5_simhash
from condist.llm.token_counts import op12_token_counts
from condist.llm.token_files import op4_token_files
from condist.llm.toxicity import op10_toxicity
from condist.llm.warc import OP3_SQL, op3_warc


QUERIES = (
    op1_packing,
    op2_quality,
    op3_warc,
    op4_token_files,
    op5_simhash,
    op6_ann,
    op7_bpe,
    op8_chat,
    op9_audio,
    op10_toxicity,
    op11_prefix_trie,
    op12_token_counts,
    op13_clusters,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op8_chat": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_clusters": OP13_SQL}
