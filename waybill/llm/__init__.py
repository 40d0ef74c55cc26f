"""Operators for preparing training data: mixing, search, scoring, filters, formatting, tokens, copies.

Functions that run in tasks travel to the executors by value, so an executor
needs numpy, pyarrow and the tokenizer libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
