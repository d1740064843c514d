"""Sources and sinks: fixtures, flight logs, conformance vectors, generators, links."""
