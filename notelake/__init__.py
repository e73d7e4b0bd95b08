"""notelake: a Spark-native analytics engine for note and document collections."""
