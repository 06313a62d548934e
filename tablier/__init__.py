"""tablier: Spark-native preparation, validation and evaluation of tabular ML data.

Every operator is a function from DataFrame(s) to DataFrame(s).  Heavy work
runs as Spark jobs; only small aggregates (class counts, confusion cells,
cut-off values, p x p Gram matrices) ever reach the driver.
"""

__version__ = "0.1.0"
