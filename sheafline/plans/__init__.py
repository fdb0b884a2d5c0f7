"""Registered plans: each query with its SQL counterpart."""
