"""Operators over cost records, series, budgets and anomalies."""
