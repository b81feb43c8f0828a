from .numeric import entropy, one_row, rnd, whole_days
from .ordered import MAX_GROUP_ROWS, by_group_size, number_rows, prepared, scan, with_blocks
from .quantiles import exact_quantiles
from .session import ensure_checkpoint_dir, stable, stored

__all__ = [
    "MAX_GROUP_ROWS",
    "by_group_size",
    "ensure_checkpoint_dir",
    "entropy",
    "exact_quantiles",
    "number_rows",
    "one_row",
    "prepared",
    "rnd",
    "scan",
    "stable",
    "stored",
    "whole_days",
    "with_blocks",
]
