"""Graph, retrieval and evaluation operators: functions from DataFrames to DataFrames."""
