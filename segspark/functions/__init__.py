from segspark.functions.binning import right_closed_bin, equal_width_bin
from segspark.functions.numeric import (
    finite_or,
    inverse_logit,
    mass_text,
    safe_div,
    strict_sum,
    tidy,
    xlnx,
)
from segspark.functions.text import invert, pad_code, replace_first, squash_suffix

__all__ = [
    "equal_width_bin",
    "finite_or",
    "inverse_logit",
    "invert",
    "mass_text",
    "pad_code",
    "replace_first",
    "right_closed_bin",
    "safe_div",
    "squash_suffix",
    "strict_sum",
    "tidy",
    "xlnx",
]
