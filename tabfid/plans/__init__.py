"""Plans: end-to-end jobs (report, synthesis) and the registered query catalog."""
