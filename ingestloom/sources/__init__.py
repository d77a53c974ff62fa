"""File sources: sniffing and readers."""
