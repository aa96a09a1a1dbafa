"""realcurve: inflation-bond return, seasonality and hedge analytics as Spark jobs."""
