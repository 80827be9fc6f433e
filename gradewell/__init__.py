"""gradewell: Spark operators for building and checking binary risk scorecards."""

import sys

from pyspark import cloudpickle

from gradewell.columns import Roles

# Tasks carry the small functions they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles"]
