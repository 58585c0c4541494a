"""Jobs with a command line: each a function that takes a session, and a small configuration."""
