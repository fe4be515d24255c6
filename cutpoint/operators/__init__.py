"""DataFrame operators shared by the reports."""
