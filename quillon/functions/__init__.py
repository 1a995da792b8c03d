"""Part of quillon; see the modules."""
