"""Analytics over corpora of text assets, on Spark."""
