"""Operators on candles, ticks, orders and trades as DataFrame transformations."""
