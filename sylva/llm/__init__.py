"""Operations of a training-data pipeline; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this folder: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
