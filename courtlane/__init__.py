"""courtlane: court-sport tracking analytics as Spark DataFrame transformations."""
