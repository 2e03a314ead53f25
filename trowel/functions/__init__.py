"""Row-local text classifiers as column expressions."""
