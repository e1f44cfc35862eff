"""sendscope — Spark-native investigation and monitoring of messaging campaigns.

Every operator takes and returns lazy ``DataFrame``s built from built-in Spark
expressions; nothing is collected to the driver except one-row aggregates whose
size is bounded by the number of columns.
"""

__version__ = "0.1.0"
