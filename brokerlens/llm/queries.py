"""The registered queries of this subpackage."""

from __future__ import annotations

from brokerlens.llm.html_extract import q_op6
from brokerlens.llm.lattice import q_op10
from brokerlens.llm.line_dedup import q_op8
from brokerlens.llm.mixing import q_op1
from brokerlens.llm.packing import q_op3
from brokerlens.llm.phrases import SQL as PHRASES_SQL
from brokerlens.llm.phrases import q_op13
from brokerlens.llm.sharding import q_op4
from brokerlens.llm.simhash import q_op7
from brokerlens.llm.spelling import q_op11
from brokerlens.llm.token_count import q_op2
from brokerlens.llm.toxicity import q_op5
from brokerlens.llm.url_filter import SQL as URL_SQL
from brokerlens.llm.url_filter import q_op12
from brokerlens.llm.winnowing import q_op9

QUERIES = {
    "op1_mix_sources": q_op1,
    "op2_token_counts": q_op2,
    "op3_packing": q_op3,
    "op4_sharding": q_op4,
    "op5_toxicity": q_op5,
    "op6_html_text": q_op6,
    "op7_simhash": q_op7,
    "op8_line_dedup": q_op8,
    "op9_winnowing": q_op9,
    "op10_embedding_links": q_op10,
    "op11_spelling": q_op11,
    "op12_url_filter": q_op12,
    "op13_phrases": q_op13,
}
ORACLE: dict[str, str] = {"op12_url_filter": URL_SQL, "op13_phrases": PHRASES_SQL}
