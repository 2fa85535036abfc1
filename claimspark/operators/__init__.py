"""DataFrame operators over pages, facts, pairs and layout rows."""
