"""What workers run is sent to them as it is: they need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def sent_by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
