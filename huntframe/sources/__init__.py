"""Readers and normalisers of logs, alerts, events, packet views and rule files."""
