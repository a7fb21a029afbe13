"""Operators for preparing text corpora for language-model training.

Nothing outside this package imports it. Kernels that run in tasks are numpy functions over the
Arrow buffers of a batch; they travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
