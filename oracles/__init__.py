"""Plain SQL for every registered query, used to check results on another engine."""
