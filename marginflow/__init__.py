"""marginflow: closed-loop margin analytics as Spark DataFrame operators.

Every operator is a function from DataFrames and parameters to a DataFrame.
There is no clock: the current day is always the ``as_of`` argument.
"""

__version__ = "0.1.0"
