"""Part of netloom; see the README."""
