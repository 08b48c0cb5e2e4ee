"""From script text to ordered statements."""
