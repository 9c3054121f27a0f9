"""Spark-native analytics for code scanning: predicates, token cascades, windows, scores, reports and training sets."""
