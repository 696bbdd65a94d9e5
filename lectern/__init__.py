"""lectern: corpus preparation, retrieval and evaluation as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame; no operator
collects data to the driver.  See README.md for the module map.
"""

__version__ = "0.1.0"
