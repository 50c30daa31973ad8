"""liftwise: promotion-lift analytics (incremental revenue and units) as Spark DataFrame jobs."""

from liftwise.tables import Tables

__version__ = "0.1.0"
__all__ = ["Tables", "__version__"]
