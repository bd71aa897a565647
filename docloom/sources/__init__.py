"""Reading requests, logs and stored corrections; writing results."""
