"""typeahead: query autocomplete analytics as Spark DataFrame jobs."""
