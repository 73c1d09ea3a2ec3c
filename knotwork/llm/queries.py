"""The registered queries of this subpackage and the SQL for their results, where SQL can say it."""

from knotwork.llm.alignment import op12
from knotwork.llm.bpe import op6
import corpus_pipeline
from knotwork.llm.bloom_lm import op7
from knotwork.llm.decontaminate import op3
from knotwork.llm.html_text import op10
from knotwork.llm.merkle import op11
from knotwork.llm.multi_index import op13
from knotwork.llm.near_dedup import op9
from knotwork.llm.oracles import ORACLES as SQL
from knotwork.llm.quality import op4
from knotwork.llm.sharding import op2
from knotwork.llm.suffix_dedup import op5
from knotwork.llm.toxicity import op8
from knotwork.llm.warc import op1

QUERIES = {
    "op1_warc": op1,
    "op2_sharding": op2,
    "op3_decontamination": op3,
    "op4_quality": op4,
    "op5_suffix_dedup": op5,
    "op6_bpe": op6,
    "op7_lm_scoring": op7,
    "op8_toxicity": op8,
    "op9_near_dedup": op9,
    "op10_html_text": op10,
    "op11_merkle": op11,
    "op12_alignment": op12,
    "op13_multi_index": op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES = dict(SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
