"""Landing, loading and writing of reports."""
