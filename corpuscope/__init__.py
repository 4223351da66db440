"""Source-code corpus analytics as DataFrame transformations."""
