from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space, as trimming takes it away.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029"


def col(c) -> Column:
    """A column by name, or a column as it is."""
    return F.col(c) if isinstance(c, str) else c
