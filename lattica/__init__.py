"""Analytics for labelled multichannel time-series trials, on Spark DataFrames."""
