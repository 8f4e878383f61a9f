"""Column-level building blocks."""

from custseg.functions.exact import dec, div, exact_round
from custseg.functions.labels import age_group, day_type, rfm_code, segment_label

__all__ = ["dec", "div", "exact_round", "age_group", "day_type", "rfm_code", "segment_label"]
