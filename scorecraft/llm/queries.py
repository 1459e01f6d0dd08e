"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from scorecraft.llm.alignment import op12_alignment
from scorecraft.llm.ann import op1_neighbours
from scorecraft.llm.chat import OP7_SQL, op7_chat
from scorecraft.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from scorecraft.llm.merkle import OP11_SQL, op11_merkle
from scorecraft.llm.mixing import OP8_SQL, op8_mixing
from scorecraft.llm.packing import op3_packing
from scorecraft.llm.quality_crf import op2_quality_crf
from scorecraft.llm.quality_rules import op10_quality_rules
from scorecraft.llm.revisits import OP6_SQL, op6_revisits
from scorecraft.llm.simhash import op13_simhash
from scorecraft.llm.token_blocks import op4_token_blocks
from scorecraft.llm.url_trust import OP9_SQL, op9_url_trust

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality_crf": op2_quality_crf,
    "op3_packing": op3_packing,
    "op4_token_blocks": op4_token_blocks,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_revisits": op6_revisits,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_url_trust": op9_url_trust,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_simhash": op13_simhash,
}

SQL = {
    "op5_jaccard_join": OP5_SQL,
    "op6_revisits": OP6_SQL,
    "op7_chat": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_url_trust": OP9_SQL,
    "op11_merkle": OP11_SQL,
}
