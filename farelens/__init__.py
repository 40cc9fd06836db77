"""Marketplace-behaviour analytics as lazy PySpark DataFrame operators."""
