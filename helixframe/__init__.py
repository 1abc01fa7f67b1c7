"""Spark-native analytics for collections of biological sequences, and training-data operators beside them."""
