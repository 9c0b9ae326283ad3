"""Scans, sinks, month bookkeeping and link discovery."""
