"""opslens: warehouse-telemetry analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` that takes an
explicit ``as_of`` timestamp instead of reading the wall clock, so the same
code runs in batch, in ``foreachBatch`` and in tests.
"""

from opslens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
