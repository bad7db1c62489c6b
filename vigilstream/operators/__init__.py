"""Operators on event tables: windows, rankings, lookups, rules, reports."""
