"""Structured Streaming jobs.  Schedules live outside: run with ``available_now`` or a trigger interval."""
