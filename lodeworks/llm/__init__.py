"""Operators for building training corpora. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import lodeworks.llm as _self

# Kernels travel to the executors by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
