"""Comment moderation analytics as Spark jobs: label, score, store and report on comments of all creators at once."""
