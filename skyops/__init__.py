"""skyops — airline operations and sales analytics as Spark DataFrame plans.

Every public operator takes DataFrames (or the :class:`~skyops.sources.airline.Airline`
namespace of tables) and returns a lazy DataFrame. Nothing is collected to the driver.
"""

from skyops.session import get_spark

__all__ = ["get_spark"]
