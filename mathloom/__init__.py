"""mathloom: a Spark-native engine for cleaning and judging corpora of math expressions."""
