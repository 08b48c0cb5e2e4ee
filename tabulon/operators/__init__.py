"""Dataset operators: each builds one lazy DataFrame plan and the structure of its result."""
