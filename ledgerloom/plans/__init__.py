"""Rules put together: the registry, diagnostics, summaries, corpus checks, reports."""
