"""Streaming operators.

The source workload has no streaming step (no watermarks, windows over
event time, state or late data), so none are built here; every operator
is a batch DataFrame function.
"""
