"""Queries of the core library over the driver's tables, and their SQL."""
