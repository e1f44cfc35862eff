from .regex import FLAG_NO, FLAG_YES, flag, matches, unicode_case
from .dates import ddmm_suffix, suffix_date
from .payload import ERROR_SIGNATURE, error_payload, is_deserialization_error, looks_like_json
from .params import blocks, param_frame

__all__ = [
    "FLAG_NO", "FLAG_YES", "flag", "matches", "unicode_case",
    "ddmm_suffix", "suffix_date",
    "ERROR_SIGNATURE", "error_payload", "is_deserialization_error", "looks_like_json",
    "blocks", "param_frame",
]
