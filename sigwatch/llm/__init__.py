"""Operators for preparing training data, each registered as a query in ``queries``."""
