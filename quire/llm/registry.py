"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chat import OP2_SQL, op2_chat
from quire.llm.jaccard import op3_jaccard
from quire.llm.langid import op10_langid
from quire.llm.lexical import OP13_SQL, op13_lexical
from quire.llm.minhash import op11_minhash
from quire.llm.mixing import op1_mixing
from quire.llm.packing import op5_packing
from quire.llm.quality import op4_quality
from quire.llm.sharding import op6_sharding
from quire.llm.topk import OP9_SQL, op9_topk
from quire.llm.toxicity import op7_toxicity
from quire.llm.trie import OP12_SQL, op12_trie
from quire.llm.url_rules import OP8_SQL, op8_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_chat": op2_chat,
        "op3_jaccard": op3_jaccard,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_urls": op8_urls,
        "op9_topk": op9_topk,
        "op10_langid": op10_langid,
        "op11_minhash": op11_minhash,
        "op12_trie": op12_trie,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op8_urls": OP8_SQL, "op9_topk": OP9_SQL, "op12_trie": OP12_SQL, "op13_lexical": OP13_SQL}
