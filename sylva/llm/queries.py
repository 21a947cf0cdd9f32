"""The queries of this folder and what SQL can say of them."""

from .chat_format import OP7_SQL, op7_chat_format
from .decontaminate import op2_decontaminate
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_text import op10_html_text
from .license_scan import op6_license_scan
from .minhash import op13_minhash_dedup
from .mixing import op3_mixing
from .nearest import op9_nearest
from .simhash import op8_simhash_dedup
from .token_count import op5_token_count
from .toxicity import op1_toxicity
from .url_filter import OP4_SQL, op4_url_filter

_ALL = (
    op1_toxicity, op2_decontaminate, op3_mixing, op4_url_filter, op5_token_count, op6_license_scan, op7_chat_format, op8_simhash_dedup, op9_nearest, op10_html_text,
    op11_fill_in_middle, op12_hard_negatives, op13_minhash_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op4_url_filter": OP4_SQL, "op7_chat_format": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_hard_negatives": OP12_SQL}
