"""segmill: media-transcript analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` over tables keyed
by recording (``rec_id``); nothing is collected to the driver.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
