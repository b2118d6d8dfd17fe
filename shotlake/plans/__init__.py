"""Plan building blocks shared by the operators: scans over ordered data that
survive a hot key, exact quantiles, and chunked folds."""

from shotlake.plans.fold import finite_fold, finite_scan, greedy_spacing
from shotlake.plans.lineage import settle
from shotlake.plans.ordered import chunk_of, ordered_scan, position
from shotlake.plans.quantile import exact_quantile
from shotlake.plans.rank import ranked

__all__ = ["chunk_of", "exact_quantile", "finite_fold", "finite_scan", "greedy_spacing", "ordered_scan", "position", "ranked", "settle"]
