"""Running results over folders that grow."""
