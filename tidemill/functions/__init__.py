"""Column expressions on candles, orders and trades."""
