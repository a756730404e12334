"""Part of the JSON document engine."""
