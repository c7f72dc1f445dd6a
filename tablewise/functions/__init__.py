"""Column-expression helpers (all JVM-side ``pyspark.sql.functions``)."""

from tablewise.functions.exprs import *  # noqa: F401,F403
from tablewise.functions.exprs import __all__  # noqa: F401
