from .expr import right_closed_bins, right_closed_bins_sql, rnd, safe_div
from .hashing import mix, mix2, mix2_sql, mix_sql, unit, unit_sql
from .prefix import cumulative_sums
from .quantiles import exact_quantiles, median

__all__ = ["right_closed_bins", "right_closed_bins_sql", "rnd", "safe_div", "mix", "mix2",
           "mix2_sql", "mix_sql", "unit", "unit_sql", "cumulative_sums", "exact_quantiles", "median"]
