"""The named analyses and the catalogue of questions they answer."""
