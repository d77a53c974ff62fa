"""DataFrame operators: row quality, de-duplication, merges, ids, references."""
