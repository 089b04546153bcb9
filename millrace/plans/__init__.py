"""Jobs that write: tables, syncs, SQL models and whole lakehouse runs."""
