"""PySpark-native analytics over document corpora and the evidence measured about them."""
