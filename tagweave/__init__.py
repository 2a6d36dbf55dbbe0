"""tagweave: symbol-index analytics over document corpora, expressed as Spark plans.

Every operator takes DataFrames keyed by ``doc_id`` (or by buffer / user for
streams) and returns DataFrames, so one Catalyst plan covers the whole corpus.
"""

from tagweave.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
