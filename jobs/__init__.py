"""Jobs over files: each has a function that takes a session, a command line and a configuration file."""
