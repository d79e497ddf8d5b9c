"""logweave: log-template analytics as Spark DataFrame operators.

Layout
------
sources/    readers: text logs, format split, CSV tables, derived views
functions/  Column expressions: masks, tokens, predicates, template rules
operators/  DataFrame -> DataFrame operators: mining, matching, metrics
plans/      registered queries (Spark side and SQL oracle side)
streaming/  Structured Streaming forms of the online operators
"""

from logweave.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
