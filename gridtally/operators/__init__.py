"""The jobs: functions from DataFrame to DataFrame."""
