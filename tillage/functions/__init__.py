"""Part of the tillage package."""
