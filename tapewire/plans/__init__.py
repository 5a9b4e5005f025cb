"""Operators composed into the panel, the refresh, models and the backtest."""
