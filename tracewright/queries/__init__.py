"""Registered queries of the core library and the SQL they are checked against."""
