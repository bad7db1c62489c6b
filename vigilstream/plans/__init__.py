"""Statement registry, script splitting, and registered queries."""
