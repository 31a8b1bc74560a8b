"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_formatting
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .exact_search import OP11_SQL, op11_exact_search
from .language_id import op6_language_id
from .mixing import op4_mixing
from .near_dedup import op8_minhash
from .packing import op3_packing
from .periodic_runs import op12_periodic_runs
from .substring_dedup import op7_substring_dedup
from .token_files import op10_token_files
from .vector_codes import OP13_SQL, op13_vector_codes
from .vector_dedup import op9_vector_dedup
from .warc import OP1_SQL, op1_warc_archive

QUERIES = {
    "op1_warc_archive": op1_warc_archive,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash": op8_minhash,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_token_files": op10_token_files,
    "op11_exact_search": op11_exact_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op1_warc_archive": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op11_exact_search": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
