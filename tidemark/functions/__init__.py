from tidemark.functions.coerce import as_flag, as_instant, as_number, as_text
from tidemark.functions.naming import member_of

__all__ = ["as_flag", "as_instant", "as_number", "as_text", "member_of"]
