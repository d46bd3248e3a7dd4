"""graphloom: typed property graphs of software and data artifacts on Spark.

Nodes and edges are DataFrames; every operation takes a :class:`graphloom.graph.Graph`
(or plain DataFrames) and returns a DataFrame with explicit columns.
"""

__version__ = "0.1.0"
