"""Pixel-table analytics for multispectral shoreline imagery, on PySpark DataFrames.

One row per ``(scene_id, row, col)`` takes the place of one array per raster file.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
