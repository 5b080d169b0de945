"""corploom: corpus preparation, retrieval and evaluation analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import corploom as _self

# Functions of this package that run in Python workers travel by value, so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_self)
