"""Operators for training-data pipelines: licences, chats, quality, secrets, pages, near copies, mixing, shards."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with their tasks, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
