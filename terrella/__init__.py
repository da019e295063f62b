"""Part of the terrella analytics engine."""
