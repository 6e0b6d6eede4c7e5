"""leafsift: find where business reports disclose given metrics, on Spark.

Every operator takes DataFrames and returns DataFrames; nothing is collected
to the driver. See README.md for a map of the package.
"""

from leafsift.session import clean_up, get_session

__all__ = ["clean_up", "get_session"]
