"""Session helpers, serving contracts and plan inspection."""
