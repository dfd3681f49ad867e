"""A Spark-native engine for curating and evaluating multi-source labelled data."""
