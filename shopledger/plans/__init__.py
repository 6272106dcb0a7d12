"""The reports: functions from cleaned tables to lazy result tables."""
