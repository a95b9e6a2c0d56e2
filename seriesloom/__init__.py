"""Time-series research on Spark: feeds, revisions, returns, rankings and coverage as DataFrame plans."""
