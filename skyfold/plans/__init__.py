"""End-to-end jobs, the driver-table fixtures and the registered queries."""
