"""strataframe: a Spark-first analytics engine for record, array, box, graph and metric data."""
