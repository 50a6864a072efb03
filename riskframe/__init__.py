"""riskframe: insurance rating and statutory-reporting operators as PySpark DataFrame functions.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects; all data work runs
as Catalyst-planned joins, aggregations and windows. Settings are small dataclasses evaluated at
plan time (``operators.validate.ColumnSetting``, ``operators.nway.NWaySpec``).
"""

from riskframe.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
