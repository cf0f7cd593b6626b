"""The hourly batch write as a stream of files."""
