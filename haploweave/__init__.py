"""Personal consensus sequences on Spark."""
