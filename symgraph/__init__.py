"""symgraph: a code-graph analytics engine on Spark DataFrames."""
