"""The queries of this subpackage, and SQL where it can express them."""

from tessel.llm.decontamination import op6_decontamination
from tessel.llm.filter_audit import OP12_SQL, op12_filter_audit
from tessel.llm.html_text import OP11_SQL, op11_html_text
from tessel.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from tessel.llm.language_id import op8_language_id
from tessel.llm.line_quality import op2_line_quality
from tessel.llm.nearest import op9_nearest
from tessel.llm.piece_encoding import op4_piece_encoding
from tessel.llm.sharding import OP5_SQL, op5_sharding
from tessel.llm.token_counts import op1_token_counts
from tessel.llm.toxicity import op3_toxicity
from tessel.llm.warc import OP7_SQL, op7_warc
from tessel.llm.whitening import op13_whitening

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_quality": op2_line_quality,
    "op3_toxicity": op3_toxicity,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_nearest": op9_nearest,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_html_text": op11_html_text,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_html_text": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
