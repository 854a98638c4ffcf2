"""rankloom: ranked-list analytics expressed as Spark DataFrame plans.

Rows are documents of a query (``qid``, ``doc_id``, ``y``, ``features``); every operator takes and returns DataFrames and
leaves the physical strategy to Catalyst and AQE.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
