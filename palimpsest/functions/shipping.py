"""Sending Python functions to tasks without installing this package on the workers."""

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Let functions of a module travel with the task instead of being imported there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
