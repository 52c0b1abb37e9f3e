from trolley.functions.caching import cached
from trolley.functions.scratch import scratch_path
from trolley.functions.sizing import BROADCAST_BYTES, broadcast_if_small, fits_broadcast

__all__ = [
    "BROADCAST_BYTES",
    "broadcast_if_small",
    "cached",
    "fits_broadcast",
    "scratch_path",
]
