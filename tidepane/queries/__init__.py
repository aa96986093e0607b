"""Registered queries: for each name a function of (session, data folder), and SQL giving the same rows."""
