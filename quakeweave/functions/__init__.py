"""Part of quakeweave."""
