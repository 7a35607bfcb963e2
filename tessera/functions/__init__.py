"""Part of the tessera catalogue analytics engine."""
