"""Whole jobs put together from operators, and the query catalogue."""
