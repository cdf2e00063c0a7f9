"""tessera: tabular profiling, cleaning, feature engineering and model
training expressed as Spark DataFrame jobs.

Every public operator takes a DataFrame (plus a few plain parameters) and
returns a DataFrame, a small fitted-parameter object, or both.  Fitting is
one or a few distributed aggregations; applying is a lazy ``select`` that
Catalyst can fuse with the surrounding plan.
"""

from tessera.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
