"""Collections analytics on Spark DataFrames.

``functions`` holds column expressions, ``operators`` row-shape and relational
steps, ``sources`` file scans and sinks, ``plans`` whole jobs, and ``catalog``
the named queries that are checked against SQL.
"""
