"""seriesmill: labelled time series as Spark DataFrame plans."""
