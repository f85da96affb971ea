"""Registered queries, their SQL, and the multi-step store plans."""
