"""Tables from files, and files from tables."""
