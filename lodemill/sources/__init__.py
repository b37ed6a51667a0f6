"""Where documents and records come from and go to."""
