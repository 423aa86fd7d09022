"""plumbline: data-quality analytics over many dataset partitions at once, on PySpark.

Every public function takes DataFrames and plain arguments and returns a lazy
DataFrame.  "Now" is always an argument (``as_of``), never the wall clock.
"""

__version__ = "0.1.0"
