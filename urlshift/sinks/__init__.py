"""Writers: rewritten tables and SQL statement texts."""
