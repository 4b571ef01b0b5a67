from ebbtide.plans.durable import durable, remove_folder, shared_folder
from ebbtide.plans.ranked import first_per_group, prefix_sum, quantiles, sliced_once
from ebbtide.plans.running import running

__all__ = [
    "durable", "first_per_group", "prefix_sum", "quantiles", "remove_folder", "running", "shared_folder",
    "sliced_once",
]
