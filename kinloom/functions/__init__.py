"""Part of Kinloom."""
