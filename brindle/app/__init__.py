"""The whole analysis over tables: configuration, analysis, reports, verification, command line."""
