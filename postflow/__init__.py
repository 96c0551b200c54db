"""Set-based DataFrame operators for listing feeds: ingest, resolve, rank, track."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Python functions that run inside tasks travel with the job, so executors need no
# copy of this package.
register_pickle_by_value(sys.modules[__name__])
