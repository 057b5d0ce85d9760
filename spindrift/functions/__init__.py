"""Part of spindrift."""
