from loomtext.functions.hashing import digest_modulo, shuffle_rank
from loomtext.functions.text import (
    good_pair,
    has_text,
    number_once,
    present,
    put_number,
    required,
    fill,
    strip,
    text_array,
    within,
)

__all__ = [
    "digest_modulo",
    "fill",
    "good_pair",
    "has_text",
    "number_once",
    "present",
    "put_number",
    "required",
    "shuffle_rank",
    "strip",
    "text_array",
    "within",
]
