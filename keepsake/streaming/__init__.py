"""Structured Streaming forms of the recurring jobs."""
from .jobs import *  # noqa: F401,F403
