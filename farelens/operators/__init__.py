"""Operators over trips, personas, offers, decisions and traces."""
