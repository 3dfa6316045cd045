"""Cairn: a prior-art and originality analytics engine on Spark DataFrames."""
