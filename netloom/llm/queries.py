"""The queries of this subpackage by name, and their SQL where SQL can say them."""

from __future__ import annotations

from netloom.llm.bpe_table import op13_bpe
from netloom.llm.conversation_repair import OP12_SQL, op12_repair
from netloom.llm.hnsw import op6_hnsw
from netloom.llm.html_extract import op7_html
from netloom.llm.lm_automaton import op2_lm
from netloom.llm.mixing import op8_mixing
from netloom.llm.packing import op5_packing
from netloom.llm.periodic_runs import op11_runs
from netloom.llm.pii import op4_pii
from netloom.llm.quality_crf import op1_quality
from netloom.llm.quality_divergence import op3_divergence
from netloom.llm.simhash import op10_simhash
from netloom.llm.warc import op9_warc


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op3_divergence": op3_divergence,
        "op4_pii": op4_pii,
        "op2_lm": op2_lm,
        "op6_hnsw": op6_hnsw,
        "op7_html": op7_html,
        "op8_mixing": op8_mixing,
        "op9_warc": op9_warc,
        "op5_packing": op5_packing,
        "op10_simhash": op10_simhash,
        "op11_runs": op11_runs,
        "op12_repair": op12_repair,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_repair": OP12_SQL}
