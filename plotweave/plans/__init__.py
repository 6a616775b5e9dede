"""Named queries over the analogue tables, with their SQL."""
