"""Reading event logs and writing results."""
