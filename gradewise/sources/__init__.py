"""Sources and sinks: the driver's tables, fixture views, file readers, writers."""
