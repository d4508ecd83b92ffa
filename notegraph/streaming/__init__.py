"""Structured Streaming: rebuild on change, feedback, turns."""
