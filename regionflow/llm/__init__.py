"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions that run inside tasks are sent with the job, so executors need no installed copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
