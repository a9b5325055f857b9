from weirline.plans.analyst import answer
from weirline.plans.arrival import RunReport, run_arrivals
from weirline.plans.curate import curate, run_batch, shape
from weirline.plans.governed import run_governed

__all__ = [
    "RunReport",
    "answer",
    "curate",
    "run_arrivals",
    "run_batch",
    "run_governed",
    "shape",
]
