"""Structured Streaming: files taken in once, tool calls put together, usage kept up to date."""
