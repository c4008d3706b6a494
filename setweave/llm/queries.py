"""The queries of this subpackage, for __spark_entry__.py."""

from setweave.llm.chat import OP1_SQL, op1_chat
from setweave.llm.contamination import OP9_SQL, op9_contamination
from setweave.llm.html import op7_html
from setweave.llm.language import op8_language
from setweave.llm.near_dup import OP4_SQL, op4_near_dup
from setweave.llm.packing import op10_packing
from setweave.llm.pii import op6_pii
from setweave.llm.quality import op2_quality
from setweave.llm.suffixes import op5_suffixes
from setweave.llm.tiles import OP3_SQL, op3_tiles

_ALL = (op1_chat, op2_quality, op3_tiles, op4_near_dup, op5_suffixes, op6_pii, op7_html, op8_language, op9_contamination, op10_packing)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_chat": OP1_SQL, "op3_tiles": OP3_SQL, "op4_near_dup": OP4_SQL, "op9_contamination": OP9_SQL}
