"""zonepulse — zone × week operational metrics analytics on Spark.

Every public operator takes Spark DataFrames and returns a lazy DataFrame.
Nothing is collected to the driver except bounded scalars.
"""

__version__ = "0.1.0"
