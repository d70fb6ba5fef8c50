"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Functions that run on executors travel with their tasks by value, so executors need the libraries
named in the README but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
