"""Multi-camera video and moving-object analytics on Spark DataFrames."""
