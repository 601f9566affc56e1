"""Training-data operators; their queries are registered in ``llm.queries``."""
