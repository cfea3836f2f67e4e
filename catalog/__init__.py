"""Registered queries on the TPC-H-like test tables, and their SQL twins."""
