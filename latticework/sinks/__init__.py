"""Where states are kept and results go."""
