"""Sources and sinks: the lake, the catalogue, downloads, stores of artifacts and of jobs."""
