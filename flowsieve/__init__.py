"""flowsieve: network-flow analytics as DataFrame, MLlib and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

from flowsieve.schema import FlowSchema, Variant

# Functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FlowSchema", "Variant"]
