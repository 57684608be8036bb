"""Set-at-a-time warranty analytics on Spark."""
