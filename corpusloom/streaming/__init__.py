"""Structured Streaming forms of arrival, session state and expiry."""
