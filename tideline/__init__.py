"""Cross-sectional signal, risk and portfolio analytics on Spark DataFrames."""
