"""Network-traffic and security analytics as DataFrame-to-DataFrame operators on Spark."""
