"""Readers and writers for logs, sessions, labels, template tables and outcome dumps."""
