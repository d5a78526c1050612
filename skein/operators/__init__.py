"""Graph operators: functions from graphs to tables keyed by vertex or edge."""
