"""Part of postmill; see the README."""
