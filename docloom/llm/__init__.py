"""Training-data operators: ten distributed steps for a text corpus.

Nothing else in ``docloom`` imports this subpackage.  Python code that runs on
executors is pickled by value, so a cluster needs no copy of this package on
its workers (only numpy, pyarrow and the named tokenizer library).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
