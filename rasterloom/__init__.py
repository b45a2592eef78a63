"""Analytics over ordered rasters and byte sequences, written as Spark plans."""
