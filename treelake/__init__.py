"""treelake: analytics over content-addressed, versioned file trees on Spark."""
