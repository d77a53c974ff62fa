"""Column expressions: null sentinels, typed casts, row serialisation."""
