"""shotlake: DataFrame operators over a whole library of media titles.

One row per frame, shot, probe, cue, tag, file or job event; every operator
takes DataFrames and returns a lazy DataFrame.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
