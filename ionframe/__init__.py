"""Part of ionframe."""
