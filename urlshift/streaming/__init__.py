"""Row-local operators on streams."""
