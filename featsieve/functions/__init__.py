from .hashing import hash32, portable_key, require_unique, with_row_key
from .numeric import digamma_int, finite, safe_div
from .state import bounded_rows, cut_lineage, local_table, session_of, spread_broadcast
from .text import folded, folded_text, stripped

__all__ = [
    "bounded_rows", "cut_lineage", "digamma_int", "finite", "folded", "folded_text", "hash32", "local_table", "portable_key", "require_unique",
    "safe_div", "session_of", "spread_broadcast", "stripped", "with_row_key",
]
