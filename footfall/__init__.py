"""Web-visitor analytics as Spark jobs: clean, sessionise, roll up and report."""
