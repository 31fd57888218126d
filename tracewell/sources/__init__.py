"""Where evidence comes from and where results go."""
