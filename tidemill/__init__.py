"""Spark-native analytics over candles, ticks, orders and trades."""
