"""Unusual-value detection for metric events, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from pulsegauge.config import GaugeConfig

# The small Python parts travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["GaugeConfig"]
