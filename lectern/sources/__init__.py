"""Where data comes from and goes to: catalog, files, conversation log."""
