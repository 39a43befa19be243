"""Names, intervals, annotation and documents of catalogued entities on Spark."""
