"""candela: panel analytics over daily price bars, built on Spark DataFrames.

Every operator is a lazy DataFrame transformation. ``Ticker`` is the
partition key for all per-series work; ``Date`` orders rows inside a series.
"""

from candela.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
