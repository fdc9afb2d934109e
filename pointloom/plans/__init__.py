"""Registered queries and longer plans."""
