"""corpusgraph: a Spark-native analytics engine for scholarly corpora and evidence graphs."""
