"""Part of loomshift."""
