"""parlance: customer-support text analytics as Spark DataFrame / SQL / ML jobs."""

__version__ = "0.1.0"
