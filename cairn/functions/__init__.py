"""Part of Cairn; see README.md."""
