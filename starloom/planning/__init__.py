"""Reasoning about queries before they run: decision diagrams, shared parts, cost gates, advice and exports."""
