"""Query plans: the dashboard's page flows and the registered query set."""
