from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column lambda).

    Catalyst copies an expression wherever a function refers to its input
    more than once; for a long regex chain that would run the chain again
    for every reference.  A higher-order function evaluates its argument
    once and binds it to the lambda variable.
    """
    return F.transform(F.array(value), body)[0]
