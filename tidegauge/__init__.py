"""tidegauge: market-breadth, sentiment-regime and event-study analytics on Spark DataFrames.

Every operator is a pure ``DataFrame -> DataFrame`` function that takes the partition ``keys`` of the
series it works on (``market`` by default; ``variant_id`` or ``benchmark`` are added where a run covers
parameter grids or several indices), so one Spark job serves all markets and all parameter sets.
"""
